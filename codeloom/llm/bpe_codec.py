"""BPE encoding and decoding (method: prefix-sharing trie traversal, see bpe.Trie)."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.bpe import trie, vocabulary
from codeloom.llm.common import mapped, read, texts


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """For each row: doc_id, ids (BINARY, little-endian unsigned 32-bit integers), n_tokens, and decoded (the ids decoded again).

    Equals the tokenizers library's encode(text, add_special_tokens=False) and decode(ids, skip_special_tokens=False)
    without truncation or padding. A null text counts as empty; empty texts give no ids and decode to an empty text.
    Repeated rows and null ids stay as they are; other columns are ignored, whatever their names. Every batch of texts is
    encoded by itself, so a task holds one batch, its distinct words and a bounded table of known words.
    """
    path = vocabulary(path)

    def rows(batch):
        pairs = trie(path).encode_batch(texts(batch), decoded)
        yield {"doc_id": batch.column(0), "ids": [i for i, _ in pairs], "n_tokens": [len(i) // 4 for i, _ in pairs], "decoded": [d.decode() for _, d in pairs] if decoded else [None] * len(pairs)}

    return mapped(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), rows, "doc_id long, ids binary, n_tokens long, decoded string")


def lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens alone, for counting; the library's model spells the words."""
    path = vocabulary(path)

    def rows(batch):
        yield {"doc_id": batch.column(0), "n_tokens": [len(i) // 4 for i, _ in trie(path, by_model=True).encode_batch(texts(batch))]}

    return mapped(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), rows, "doc_id long, n_tokens long")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() with both results hashed where they are made."""
    path = vocabulary(path)

    def rows(batch):
        pairs = trie(path).encode_batch(texts(batch), True)
        yield {"doc_id": batch.column(0), "n_tokens": [len(i) // 4 for i, _ in pairs], "ids_sha256": [sha256(i).hexdigest() for i, _ in pairs], "decoded_sha256": [sha256(d).hexdigest() for _, d in pairs]}

    return mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
