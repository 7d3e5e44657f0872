"""Many literal markers at once: one automaton over a vocabulary, run over texts where they are."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import materialize

#: Bytes of terms in one automaton (about thirty times that in memory).
SLICE_BYTES = 4 << 20


def load_pack(spark: SparkSession, path: str, kind: type):
    """A language pack (``claims.Markers``, ``traces.TracePack``) from a JSON file of lists, which Spark reads from any store.

    Keys that the pack does not know and values that are not lists of texts raise.
    """
    content = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(content) - known):
        raise ValueError(f"unknown lists in the pack: {unknown}")
    if wrong := sorted(k for k, v in content.items() if not isinstance(v, list) or not all(isinstance(x, str) for x in v)):
        raise ValueError(f"not lists of texts: {wrong}")
    return kind(**{k: tuple(v) for k, v in content.items()})


_automata: dict = {}


def _automaton(name: str, terms: list[str]):
    """One automaton a process for the same slice."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for t in terms:
            made.add_word(t, t)
        made.make_automaton()
        _automata[name] = made
    return _automata[name]


def marker_hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, every: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``id_col``, ``term`` and ``start`` (from 0, in characters) of all places of all terms, overlapping ones too.

    ``terms`` has ``term``. Without ``every``, each term of a text comes once, at its first place. Terms are found
    as they stand, anywhere in the text. The vocabulary is cut into slices of bounded size, each of which passes
    over the texts once, so no text is shuffled; empty and null terms, and null texts, find nothing.
    """
    known = materialize(terms.select("term").filter("term <> ''").distinct())
    total = known.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    slices = max(1, -(-total // slice_bytes))
    plain = texts.select(F.col(id_col), F.col(text_col).alias("_text"))
    schema = StructType([plain.schema[id_col], *StructType.fromDDL("term string, start int").fields])
    found = None
    for i in range(slices):
        own = [r["term"] for r in known.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == i).collect()]  # slice_bytes
        part = plain.mapInArrow(_finder(uuid.uuid4().hex, own, schema, every), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _finder(name: str, terms: list[str], schema: StructType, every: bool):
    def hits(text: str | None, machine) -> Iterator[tuple[str, int]]:
        seen = set()
        for end, term in machine.iter(text) if text else ():
            if every or term not in seen:
                seen.add(term)
                yield term, end - len(term) + 1

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches if terms else ():
            machine = _automaton(name, terms)
            for at in range(0, batch.num_rows, 256):
                rows = [(i, t, s) for i, text in enumerate(batch.column(1).slice(at, 256).to_pylist()) for t, s in hits(text, machine)]
                ids = batch.column(0).slice(at, 256).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.cast(target[0].type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], schema=target)

    return run
