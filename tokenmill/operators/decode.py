"""Token IDs back to text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.functions.bytelevel import byte_symbols
from tokenmill.operators.vocabulary import Vocabulary


class Names:
    """The bytes of every token ID, in one array with offsets."""

    def __init__(self, tokens: dict[str, int], raw: bool) -> None:
        back = {symbol: bytes([byte]) for byte, symbol in enumerate(byte_symbols())}
        # of several tokens with one ID the greatest counts
        by_id = {i: token for token, i in sorted(tokens.items())}
        self.ids = np.array(sorted(by_id), dtype=np.int64)
        names = [by_id[i] for i in self.ids.tolist()]
        if raw:
            data = [n.encode() for n in names]
        else:
            data = [b"".join(back.get(c) or c.encode() for c in n) for n in names]
        self.bytes = pa.array([*data, b""], pa.binary())

    def joined(self, rows: pa.Array) -> pa.Array:
        """The bytes of each row of IDs; unknown IDs are passed over."""
        values = rows.flatten().fill_null(-1).to_numpy().astype(np.int64)
        place = np.searchsorted(self.ids, values)
        known = place < len(self.ids)
        known[known] = self.ids[place[known]] == values[known]
        named = self.bytes.take(pa.array(np.where(known, place, len(self.ids))))
        sizes = pc.list_value_length(rows).fill_null(0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pc.binary_join(pa.ListArray.from_arrays(offsets, named), b"")


def decode_tokens(
    encoded: DataFrame,
    vocab: Vocabulary,
    keys: Sequence[str] = ("doc_id",),
    mode: str = "text",
) -> DataFrame:
    """``text`` of every row of ``token_ids``.

    ``raw`` joins the token strings as they are, ``text`` turns the byte
    alphabet back into characters. Unknown IDs are passed over. Rows are decoded
    where they are, by one gather for each batch.
    """
    if mode not in ("raw", "text"):
        raise ValueError("mode is 'raw' or 'text'")
    names = Names(vocab.mapping, mode == "raw")
    columns = [*keys, "_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = names.joined(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], joined], names=columns)

    rows = encoded.select(*keys, "token_ids")
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("_bytes binary").fields])
    return rows.mapInArrow(run, schema).select(*keys, F.decode("_bytes", "UTF-8").alias("text"))
