"""Token counts: Arrow functions that return lengths only, over batches balanced by bytes."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kept, safe_pieces, spread


def _counter(path: str):
    """A function from texts to token counts by the library that the file's name tells, and whether texts may be cut."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)], True


def count_column(path: str, batch_bytes: int, piece_chars: int):
    def count(texts: pa.Array) -> pa.Array:
        encode, can_cut = kept(("tokens", path), lambda: _counter(path))
        totals = [0] * len(texts)
        batch: list[str] = []
        owners: list[int] = []
        held = 0

        def flush():
            for owner, n in zip(owners, encode(batch), strict=True):
                totals[owner] += n
            batch.clear()
            owners.clear()

        for i, raw in enumerate(as_bytes(texts)):
            text = raw.decode("utf-8", "replace")
            for piece in safe_pieces(text, piece_chars) if can_cut else (text,):
                batch.append(piece)
                owners.append(i)
                held += len(raw) if len(piece) == len(text) else len(piece.encode())
                if held >= batch_bytes:
                    flush()
                    held = 0
        if batch:
            flush()
        return pa.array(totals, pa.int64())

    return F.arrow_udf(count, "long")


def count_tokens(
    df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16
) -> DataFrame:
    """``df`` with the column ``out``: tokens of the whole ``text`` under the tokenizer file at ``path``.

    The file is read on the executors, so ``path`` must hold on each of them. Texts are sent in pieces of about
    ``piece_chars`` characters, cut where byte-level patterns never join (sentencepiece texts are sent whole), in
    batches of about ``batch_bytes``; only the lengths come back. Null counts as empty: 0 tokens. Special strings
    inside texts are handled as the library does by default. Equal rows get equal counts; an empty table gives an
    empty table; a column named ``out`` is replaced.
    """
    return spread(df).withColumn(out, count_column(path, batch_bytes, piece_chars)(F.col(text)))
