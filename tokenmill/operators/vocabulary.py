"""Vocabulary tables and their measured bounds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.bytelevel import byte_symbols
from tokenmill.sizes import BROADCAST_BYTES, BROADCAST_ROWS


@dataclass(frozen=True)
class Vocabulary:
    """``tokens(token, token_id)`` with the figures the jobs plan by."""

    tokens: DataFrame
    n_tokens: int
    n_bytes: int
    longest: int
    single_ids: tuple[int | None, ...]

    @property
    def covers_all_bytes(self) -> bool:
        """Whether each of the 256 byte symbols is a token."""
        return None not in self.single_ids

    @property
    def space_id(self) -> int | None:
        return self.single_ids[ord(" ")]

    def sized(self, table: DataFrame) -> DataFrame:
        """A table of at most this vocabulary's size, marked for broadcast
        while that is in bounds."""
        if self.n_tokens <= BROADCAST_ROWS and self.n_bytes <= BROADCAST_BYTES:
            return F.broadcast(table)
        return table

    def lookup(self) -> DataFrame:
        return self.sized(self.tokens)

    @cached_property
    def mapping(self) -> dict[str, int]:
        """Token to ID, for structures that are sent to every task; refused
        beyond the broadcast bounds. Of equal tokens the last ID counts."""
        if self.n_tokens > BROADCAST_ROWS or self.n_bytes > BROADCAST_BYTES:
            raise ValueError(f"a vocabulary of {self.n_tokens} tokens and {self.n_bytes} bytes is too large to send")
        return {r.token: r.token_id for r in self.tokens.orderBy("token_id").collect()}


def vocabulary(tokens: DataFrame) -> Vocabulary:
    """Measure a ``(token, token_id)`` table in one small aggregation.

    Negative IDs count as absent, as in a lookup that answers -1 for a miss.
    """
    tokens = tokens.select("token", F.col("token_id").cast("int")).filter("token_id >= 0")
    symbols = byte_symbols()
    single = F.when(F.col("token").isin(symbols), F.struct("token", "token_id"))
    row = tokens.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("token") + 4).alias("size"),
        F.max(F.length("token")).alias("longest"),
        # at most one entry per byte
        F.collect_set(single).alias("single"),
    ).first()
    ids = {entry.token: entry.token_id for entry in row.single}
    return Vocabulary(
        tokens=tokens,
        n_tokens=row.n,
        n_bytes=row.size or 0,
        longest=row.longest or 0,
        single_ids=tuple(ids.get(s) for s in symbols),
    )
