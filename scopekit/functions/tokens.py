"""Token counts: the estimate that budgets use, and exact counts by a tokenizer's vocabulary file (its path is a parameter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopekit import fixed_values as FV


def token_estimate(text, chars_per_token: float = FV.CHARACTERS_PER_TOKEN) -> Column:
    """ceil(characters / chars_per_token) as bigint."""
    t = F.col(text) if isinstance(text, str) else text
    return tokens_of_length(F.length(t), chars_per_token)


def tokens_of_length(n_chars, chars_per_token: float = FV.CHARACTERS_PER_TOKEN) -> Column:
    """The estimate for a text of so many characters."""
    n = F.col(n_chars) if isinstance(n_chars, str) else n_chars
    return F.ceil(n / F.lit(float(chars_per_token))).cast("bigint")


VOCABULARY_LIMIT = 64 << 20     # bytes of a vocabulary that is broadcast
TEXTS_AT_ONCE = 64


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path(name)


def exact_token_counts(df: DataFrame, text_col: str, vocabulary: str, special_tokens: bool = False) -> DataFrame:
    """The rows with ``n_tokens``, the number of ids that the tokenizer gives for the text; null for a null text.

    The vocabulary file (a few megabytes, checked) is broadcast once, and each Python worker builds its tokenizer from it
    once per task; texts pass in Arrow batches.
    """
    import os

    import pyarrow as pa

    from scopekit.operators.batch import ship_by_value
    if os.path.getsize(vocabulary) > VOCABULARY_LIMIT:
        raise ValueError(f"{vocabulary} is larger than a vocabulary may be")
    with open(vocabulary, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    ship_by_value()

    def run(batches):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            texts, counts = batch.column(text_col).to_pylist(), []
            for start in range(0, len(texts), TEXTS_AT_ONCE):
                some = texts[start:start + TEXTS_AT_ONCE]
                found = tokenizer.encode_batch_fast([t or "" for t in some], add_special_tokens=special_tokens)
                counts += [None if t is None else len(e.ids) for t, e in zip(some, found)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])
    keep = [c for c in df.columns if c not in (text_col, "n_tokens")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{schema}, n_tokens bigint")
