"""User hooks on pages: Python callables run over Arrow batches, with a report on their output."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose results are held at a time.
PIECE = 128
SCHEMA = "recipe_id string, page_id long, title string, html string, removed long, status string"


class Recipe(NamedTuple):
    """clean(html, params) -> (html, removed) and extract(html, params) -> {title, html} or None."""

    recipe_id: str
    clean: Callable | None
    extract: Callable


def hook_pipeline(pages: DataFrame, recipe: Recipe, params: dict | None = None) -> DataFrame:
    """SCHEMA rows: the recipe's hooks in order on every page; a hook that raises gives status `error`, a null extraction `null`."""
    params = dict(params or {})

    def run(frames):
        for pdf in (whole[at : at + PIECE] for whole in frames for at in range(0, len(whole), PIECE)):
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                removed = title = body = None
                try:
                    text = html or ""
                    if recipe.clean:
                        text, removed = recipe.clean(text, params)
                    found = recipe.extract(text, params)
                    title, body = (found.get("title"), found.get("html")) if found is not None else (None, None)
                    status = "null" if found is None else "ok"
                except Exception:  # noqa: BLE001 - a user hook may raise anything; the report counts it
                    status = "error"
                rows.append((recipe.recipe_id, page_id, title, body, removed, status))
            yield pd.DataFrame(rows, columns=["recipe_id", "page_id", "title", "html", "removed", "status"]).astype({"removed": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA)


def hook_contract(output: DataFrame) -> DataFrame:
    """(recipe_id, rule, n_rows): rows of hook output that break a rule of the contract."""
    ok = F.col("status") == "ok"
    rules = {
        "raised": F.col("status") == "error",
        "null_result": F.col("status") == "null",
        "no_title": ok & F.col("title").isNull(),
        "no_html": ok & F.col("html").isNull(),
        "empty_html": ok & (F.trim("html") == ""),
        "no_removed": F.col("removed").isNull() & (F.col("status") != "error"),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return output.select("recipe_id", F.explode(broken).alias("rule")).groupBy("recipe_id", "rule").agg(F.count(F.lit(1)).alias("n_rows"))
