"""Token counts by the whole-token shortcut (see wordbpe)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textops as T, wordbpe
from .common import documents

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of `docs`.

    Vocabulary strings proven to encode alone as one token are counted directly; all other pre-tokens
    are merged, once for each worker. Null counts as empty: no bytes, no tokens. A null doc_id stays
    null; repeated rows are counted each; an empty table gives no rows.
    """

    def run(batches):
        model = wordbpe.load(vocabulary)
        for b in T.slices(batches):
            buf, offs = T.utf8(b.column(1))
            n = model.counts(buf, offs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(n), pc.greater(pa.array(n), limit)], schema=OUT)

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
