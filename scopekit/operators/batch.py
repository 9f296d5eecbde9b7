"""Resumable batch scoring.

Pending documents are an anti join against the finished ids; prompts go to a
user scorer through ``mapInPandas`` (Arrow batches, one Python worker per
task; a batch is capped by ``spark.sql.execution.arrow.maxRecordsPerBatch`` and
``spark.sql.execution.arrow.maxBytesPerBatch``, so budget-sized prompts never
build an unbounded batch); outputs are trimmed and validated on the JVM, and
every failure becomes the stub record with a status, so one bad document never
stops the job.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.records import SCOPES, empty_struct, stub_struct, trim_marker
from scopekit.operators.outputs import validate_responses
from scopekit.operators.prompts import STATUS_OK, STATUS_OVER

Scorer = Callable[[pd.Series], pd.Series]


def pending(docs: DataFrame, done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents without a stored output."""
    return docs.join(done.select(F.col("id").alias(id_col)), id_col, "left_anti")


def _score_batches(scorer: Scorer) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def call(prompts: pd.Series) -> pd.Series:
        if prompts.empty:
            return pd.Series([], index=prompts.index, dtype=object)
        try:
            out = scorer(prompts)
            if len(out) != len(prompts):
                raise ValueError("scorer returned a different number of outputs")
            return pd.Series(list(out), index=prompts.index, dtype=object)
        except Exception:  # a failing batch is retried row by row
            vals = []
            for prompt in prompts:
                try:
                    vals.append(scorer(pd.Series([prompt])).iloc[0])
                except Exception:
                    vals.append(None)
            return pd.Series(vals, index=prompts.index, dtype=object)

    def run(batches):
        for pdf in batches:
            todo = pdf["status"] == STATUS_OK
            response = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            response[todo] = call(pdf.loc[todo, "prompt"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "status": pdf["status"], "response": response})
    return run


def ship_by_value() -> None:
    """Serialise this package's functions by value, so Python workers need no
    installed copy of it (a cluster would otherwise need it on every node)."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules["scopekit"])


def score(prompts: DataFrame, scorer: Scorer, id_type: str = "bigint") -> DataFrame:
    """(doc_id, status, response): the scorer's raw text for every 'ok' prompt; other rows
    pass through unscored (null response), and a scorer error gives null."""
    ship_by_value()
    return prompts.select("doc_id", "status", "prompt").mapInPandas(
        _score_batches(scorer), f"doc_id {id_type}, status string, response string")


def batch_records(prompts: DataFrame, scorer: Scorer, marker: str = FV.EOS_MARKER,
                  id_type: str = "bigint") -> DataFrame:
    """(doc_id, status, scope_1, scope_2, scope_3, sources) for every prompt row, in one pass.

    'ok' prompts are scored; an invalid or missing output becomes the stub with
    status 'failed'. 'over_budget' documents get the stub, documents without
    relevant pages the all-null record; neither is scored.
    """
    scored = score(prompts, scorer, id_type)
    trimmed = scored.select("doc_id", "status", trim_marker("response", marker).alias("response"))
    v = validate_responses(trimmed, "response")
    ok, valid = F.col("status") == STATUS_OK, F.col("valid")
    parsed = F.struct(*[F.col(k) for k in SCOPES], F.col("sources"))
    rec = (F.when(ok & valid, parsed).when(ok | (F.col("status") == STATUS_OVER), stub_struct())
            .otherwise(empty_struct()))
    status = F.when(ok & ~valid, F.lit("failed")).otherwise(F.col("status"))
    out = v.select("doc_id", status.alias("status"), rec.alias("r"))
    return out.select("doc_id", "status", *[F.col(f"r.{k}").alias(k) for k in SCOPES],
                      F.col("r.sources").alias("sources"))


def chunk_echo_scorer(prompts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a language model (tests and benchmarks).

    scope_1 = number of chunks, scope_2 = prompt length, scope_3 = null for
    even lengths else length mod 1000, sources = the chunk ids; an end marker
    follows. More than five chunks make an invalid output, as a model citing
    too many pages would.
    """
    s = prompts.fillna("")
    ids = s.str.findall(r'<CHUNK id="(\d+)">')
    n = ids.str.len()
    length = s.str.len()
    s3 = (length % 1000).astype(str).where(length % 2 == 1, "null")
    src = ids.str.join(",")
    return ('{"scope_1":' + n.astype(str) + ',"scope_2":' + length.astype(str) + ',"scope_3":' + s3
            + ',"sources":[' + src + "]}" + FV.EOS_MARKER)
