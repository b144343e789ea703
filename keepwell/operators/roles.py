"""Finding the business meaning of columns by their names.

Works on a catalogue of headings (`table`, `position`, `column`) so that any number of tables is one job. Headings repeat,
so a task compares each different normalised name with the aliases once; only (table, role, best column) is shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell import domain
from keepwell.functions.values import normalize_name

# tasks get this module's functions with the job, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADINGS = "table string, position long, column string"


def headings(df: DataFrame, table: str = "table") -> DataFrame:
    """The catalogue of one DataFrame's own columns."""
    rows = [(table, position, name) for position, name in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, HEADINGS)


def _plain(alias: str, style: str) -> str:
    kept = [c for c in alias.lower() if c.isalnum()] if style == "fuzzy" else [c for c in alias if c not in " -_"]
    return "".join(kept)


class Matcher:
    """The roles a normalised name can stand for, found once for each different name.

    A role's aliases are one pattern, which tells whether the name holds any; a table of all parts of aliases tells
    whether an alias holds the name.
    """

    def __init__(self, style: str, aliases: dict[str, list[str]], names_kept: int = 200_000):
        plain = {role: sorted({_plain(text, style) for text in texts}) for role, texts in aliases.items()}
        self.exact = {role: frozenset(texts) for role, texts in plain.items()}
        self.patterns, self.parts = {}, {}
        if style == "fuzzy":
            self.patterns = {role: re.compile("|".join(map(re.escape, texts))) for role, texts in plain.items()}
            for role, texts in plain.items():
                for text in texts:
                    for start in range(len(text)):
                        for end in range(start + 1, len(text) + 1):
                            self.parts.setdefault(text[start:end], set()).add(role)
        self.names_kept, self.known = names_kept, {}

    def roles(self, name: str) -> list[tuple[str, bool]]:
        """(role, whether the name is an alias of it)."""
        found = self.known.get(name)
        if found is None:
            if len(self.known) >= self.names_kept:
                self.known.clear()
            inside = self.parts.get(name, ())
            found = self.known[name] = [
                (role, name in texts) for role, texts in self.exact.items()
                if name in texts or role in inside or (role in self.patterns and self.patterns[role].search(name))]
        return found


def with_roles(named: DataFrame, style: str, aliases: dict[str, list[str]]) -> DataFrame:
    """(table, position, column, role, exact) for each role that the row's `name` can stand for; nothing is shuffled."""
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("table", "position", "column")) + ", role string, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(style, aliases)
        for batch in batches:
            names = batch.column("name").dictionary_encode()
            codes = names.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
            rows, roles, exact = [], [], []
            for code, name in enumerate(names.dictionary.to_pylist()):
                for role, same in matcher.roles(name):
                    here = order[edges[code]:edges[code + 1]]
                    rows.append(here)
                    roles += [role] * len(here)
                    exact += [same] * len(here)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in ("table", "position", "column")), pa.array(roles, pa.string()),
                     pa.array(exact, pa.bool_())], ["table", "position", "column", "role", "exact"])

    return named.select("table", "position", "column", "name").mapInArrow(run, schema)


def detect_roles(columns_df: DataFrame, mode: str = "fuzzy") -> DataFrame:
    """(table, role, column, exact) for every role a table's headings reveal.

    `fuzzy`: an exact alias wins, then a name containing an alias or contained in one; the first column wins.
    `exact`: aliases only, the older role list. Names that normalise to nothing match no role.
    """
    style, aliases = ("fuzzy", domain.ROLE_ALIASES) if mode == "fuzzy" else ("strict", domain.EXACT_ROLE_ALIASES)
    named = columns_df.select("table", "position", "column", normalize_name("column", style).alias("name"))
    named = named.where(F.col("name") != "")
    if mode == "exact":
        # among columns that normalise alike the last spelling stands, at the place of the first
        texts = sorted({_plain(text, style) for listed in aliases.values() for text in listed})
        named = named.where(F.col("name").isin(texts)).groupBy("table", "name").agg(
            F.max(F.struct("position", "column"))["column"].alias("column"), F.min("position").alias("position"))
    matched = with_roles(named, style, aliases)
    best = F.min(F.struct((~F.col("exact")).alias("partial"), "position", "column"))
    return matched.groupBy("table", "role").agg(best.alias("best")).select(
        "table", "role", F.col("best.column").alias("column"), (~F.col("best.partial")).alias("exact"))


def role_report(detected: DataFrame, tables: DataFrame, mode: str = "fuzzy") -> DataFrame:
    """Every role of every table, with its column or `Not detected`."""
    roles = list(domain.ROLE_ALIASES if mode == "fuzzy" else domain.EXACT_ROLE_ALIASES)
    wanted = tables.select("table").distinct().select("table", F.explode(F.array(*map(F.lit, roles))).alias("role"))
    return wanted.join(detected.select("table", "role", "column"), ["table", "role"], "left").select(
        "table", "role", F.coalesce("column", F.lit("Not detected")).alias("column"))


def roles_of(df: DataFrame, mode: str = "fuzzy") -> dict[str, str | None]:
    """The role map of one DataFrame: at most eight rows of metadata on the driver."""
    aliases = domain.ROLE_ALIASES if mode == "fuzzy" else domain.EXACT_ROLE_ALIASES
    found = {r["role"]: r["column"] for r in detect_roles(headings(df), mode).collect()}
    return {role: found.get(role) for role in aliases}


def resolve_roles(detected: dict[str, str | None], overrides: dict[str, str | None],
                  columns: list[str]) -> dict[str, str | None]:
    """User choices over detected roles; None clears a role, an unknown role or column is refused."""
    strange = sorted(set(overrides) - set(domain.ROLE_ALIASES) - set(detected))
    if strange:
        raise ValueError("No such roles: " + ", ".join(strange))
    unknown = sorted(c for c in overrides.values() if c is not None and c not in columns)
    if unknown:
        raise ValueError("No such columns: " + ", ".join(unknown))
    return {**detected, **overrides}


def role_frame(spark: SparkSession, roles: dict[str, str | None]) -> DataFrame:
    """A resolved role map as a table."""
    rows = [(role, column or "Not detected") for role, column in roles.items()]
    return spark.createDataFrame(rows, "role string, column string")
