"""Frequency of every distinct value: occurrences, records and a mark.

Last-seen counters. Tokens are read record by record; a term's counter holds its
occurrences, its records and the last record that held it, so a token of the record seen
last adds an occurrence only and no set of records is ever kept. Tokens are counted where
their record is read, and only the counters are hash-partitioned by term: they add up
exactly, because the tokens of a record are read by one task, and a term of a third of all
records is one counter a task like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.common import cut, once

COMMON_SHARE = 0.01
RARE_BELOW = 3
#: Counters a task keeps before it passes them on and starts again.
COUNTERS = 1_000_000
BLANKS = " \t\n"

_OUT = pa.schema([("field", pa.string()), ("term", pa.string()), ("n_occ", pa.int64()), ("n_records", pa.int64())])


class Counters:
    """Term: [occurrences, records, last record]; None for all terms of the field together.

    Records are numbered as they are met."""

    def __init__(self):
        self.held: dict[tuple, list[int]] = {}

    def add(self, field: str, values: pa.Array, records: np.ndarray) -> None:
        """Count a run of tokens, ordered by record. Equal tokens of the run are counted together:
        sorted by term and still by record, each is compared with the token before it, and the
        first of a term with the counter's last record."""
        coded = pc.dictionary_encode(values)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        c, r = codes[order], records[order]
        first = np.flatnonzero(np.diff(c, prepend=-1))
        new = np.diff(r, prepend=-1) != 0
        new[first] = True
        occurrences, seen = np.diff(np.append(first, len(c))), np.add.reduceat(new.astype(np.int64), first)
        last = r[np.append(first[1:], len(c)) - 1]
        terms = zip(coded.dictionary.to_pylist(), occurrences.tolist(), seen.tolist(), r[first].tolist(), last.tolist())
        every = int((np.diff(records, prepend=-1) != 0).sum())
        for term, n, held, begin, end in (*terms, (None, len(values), every, int(records[0]), int(records[-1]))):
            k = self.held.get((field, term))
            if k is None:
                self.held[field, term] = [n, held, end]
            else:
                k[0] += n
                k[1] += held - (k[2] == begin)
                k[2] = end

    def taken(self) -> pa.RecordBatch:
        """The counters, which start again."""
        rows, self.held = self.held, {}
        columns = [k[0] for k in rows], [k[1] for k in rows], [v[0] for v in rows.values()], [v[1] for v in rows.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def _counter(fields: list[str], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, met, before = Counters(), -1, object()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("_record")
            same = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            changed = np.diff(same, prepend=-1) != 0
            changed[0] = keys[0].as_py() != before
            if changed[0] and len(counters.held) > limit:  # between records, so that none is cut in two
                yield counters.taken()
            numbers = met + np.cumsum(changed)
            met, before = int(numbers[-1]), keys[-1].as_py()
            for field in fields:
                lists = batch.column(field)
                at = pc.list_parent_indices(lists)
                values = pc.utf8_trim(pc.list_flatten(lists).cast(pa.string()), characters=BLANKS)
                keep = pc.fill_null(pc.greater(pc.utf8_length(values), 0), False)
                values, at = values.filter(keep), at.filter(keep)
                if len(values):
                    counters.add(field, values, numbers[at.to_numpy(zero_copy_only=False)])
        if counters.held:
            yield counters.taken()

    return run


def term_counts(rows: DataFrame, record: str, fields: list[str], limit: int = COUNTERS) -> DataFrame:
    """(field, term, n_occ, n_records) over ``rows``, the rows of a record one after the other
    in one partition (one row a record, or sorted so).

    Values are cut of spaces, tabs and line feeds at their ends; null and blank values are
    left out; a null array equals an empty one. The row of a field with null ``term`` holds
    the totals: values, and records with at least one. A null record id is a record like any
    other. See :func:`frequencies` for rows delivered again.
    """
    lists = rows.select(F.col(record).alias("_record"), *[F.coalesce(F.col(f).cast("array<string>"), F.array().cast("array<string>")).alias(f) for f in fields])
    part = lists.mapInArrow(_counter(fields, limit), "field string, term string, n_occ long, n_records long")
    return part.groupBy("field", "term").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_records").alias("n_records"))


def frequencies(rows: DataFrame, record: str, fields: list[str], common: float = COMMON_SHARE, rare: int = RARE_BELOW) -> DataFrame:
    """(field, term, n_occ, n_records, mark): every distinct value of the fields.

    ``mark`` is 'common' if more than the share ``common`` of the records with a value hold
    it, else 'rare' if fewer than ``rare`` do, else 'ok'. Rows delivered again (same record
    id) count once, the latest by ``loaded_at``. An empty table gives no rows. The counts are
    written once to the shared folder: the totals are read from them before the terms.
    """
    counts = cut(term_counts(once(rows.select(record, *fields, "loaded_at"), record), record, fields))
    totals = counts.filter("term is null").select("field", F.col("n_records").alias("_all"))
    mark = F.when(F.col("n_records") > common * F.col("_all"), "common").when(F.col("n_records") < rare, "rare").otherwise("ok")
    out = counts.filter("term is not null").join(F.broadcast(totals), "field")  # one row a field
    return out.select("field", "term", "n_occ", "n_records", mark.alias("mark"))
