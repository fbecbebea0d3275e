"""Text jobs: normalising, quote grounding, key canonicalisation, sections."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Punctuation that is folded, and legal forms that names end in.
FOLD_FROM, FOLD_TO = "‘’“”–—…", "''\"\"--."
LEGAL = r"\b(incorporated|inc|corporation|corp|company|co|limited|ltd|llc|plc|sa|ag|gmbh|holdings?|group)\b\.?"


def normalise(x) -> Column:
    """Folded punctuation, lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(F.translate(x, FOLD_FROM, FOLD_TO)), r"[ \t\n\r\f\x0b]+", " "))


def grounded(quote, document, least: int = 12) -> Column:
    """Is every fragment of the quote (between ellipses, short ones left out) in the document? Both normalised.
    A quote of short fragments alone must be there as a whole; an empty one is in any."""
    same = lambda x: F.translate(x, "ς", "σ")  # noqa: E731  a sigma at the end of a cut quote
    parts = F.filter(F.transform(F.split(same(quote), r"\.\.\."), lambda p: F.trim(p)), lambda p: F.length(p) >= least)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(same(quote)))
    return F.forall(parts, lambda p: F.contains(same(document), p))


def canonical_key(name) -> Column:
    """Counterparty key: no bracketed gloss, no legal form, letters and digits only, joined by '-'."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), LEGAL, " ")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), " +", "-")


def sections(df: DataFrame, text: str, headings: Sequence[str]) -> DataFrame:
    """df's rows by section: heading (exact line) and the body up to the next heading."""
    marked = F.regexp_replace(F.concat(F.lit("\n"), F.col(text), F.lit("\n")), "\n(" + "|".join(headings) + ")(?=\n)", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    part = F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("__p")
    d = df.select(*[c for c in df.columns if c != text], part)
    return d.select(*[c for c in d.columns if c != "__p"], F.split("__p", "\u0002")[0].alias("heading"), F.regexp_replace(F.split("__p", "\u0002")[1], r"^\s+|\s+$", "").alias("body"))


def _found(tree) -> Iterator[tuple[str, dict]]:
    """Objects with quote, source and strength, at any depth, with their paths."""
    open_ = [("", tree)]
    while open_:
        path, node = open_.pop()
        if isinstance(node, dict):
            if {"quote", "source", "strength"} <= node.keys():
                yield path, node
            open_ += [(f"{path}.{k}" if path else k, v) for k, v in node.items()]
        elif isinstance(node, list):
            open_ += [(f"{path}[{i}]", v) for i, v in enumerate(node)]


def evidence(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, path, quote, source, strength of every evidence object in a JSON text; text that is no JSON has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[payload]):
                try:
                    tree = json.loads(text) if text else None
                except ValueError:
                    continue
                rows += [(k, path, *(None if e[n] is None else str(e[n]) for n in ("quote", "source", "strength"))) for path, e in _found(tree)]
            yield pd.DataFrame(rows, columns=[key, "path", "quote", "source", "strength"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, payload).mapInPandas(run, f"`{key}` {kind}, path string, quote string, source string, strength string")
