"""Token counts with a digest cache: only texts never counted before are encoded."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import shared_folder

CACHE_SCHEMA = "digest binary, n_tokens long"
#: Texts handed to the tokenizer at once; longer lists only hold more memory.
BATCH_CHARS = 1 << 20
#: A longer run without a space goes to the library itself.
LONG_RUN = 4096
#: Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file and of the library's version, which together fix the counts."""
    if path.endswith(".json"):
        import tokenizers as library
    elif path.endswith(".model"):
        import sentencepiece as library
    else:
        raise ValueError(f"not a tokenizer file of a known kind: {path}")
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + library.__version__.encode()).hexdigest()[:32]


class ByteLevelCounts:
    """Counts of a byte-level BPE vocabulary whose merges are in the order of their ids.

    The merges run in tiktoken, which is several times as fast and gives the same counts for the
    same vocabulary. Texts in which an added token occurs, or with a very long run without spaces,
    go to the library itself.
    """

    def __init__(self, library, spec: dict) -> None:
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
        moved = [b for b in range(256) if b not in set(plain)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
        added = [x["content"] for x in spec["added_tokens"]]
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        self.library, self.added = library, added
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def odd(self, text: str) -> bool:
        return any(x in text for x in self.added) or len(text) > LONG_RUN and max(map(len, text.split(" "))) > LONG_RUN

    def __call__(self, texts: list[str]) -> list[int]:
        return [self.library([x])[0] if self.odd(x) else len(self.fast(x)) for x in texts]


def counter(path: str):
    """A function from a list of texts to their numbers of tokens, without special tokens added."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        spec = json.loads(tokenizer.to_str())
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        bare = not spec.get("normalizer") and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not bare or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            return encode
        ids = [model["vocab"][a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        return ByteLevelCounts(encode, spec) if ids == sorted(ids) else encode
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(model.encode(x)) for x in texts]


_COUNTERS: dict[str, object] = {}


def _encode(path: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if version not in _COUNTERS:
            _COUNTERS[version] = counter(path)
        count = _COUNTERS[version]
        for batch in batches:
            texts, counts, held, size = batch.column(1), [], [], 0
            for text in texts:
                held.append(text.as_py())
                size += len(held[-1])
                if size >= BATCH_CHARS:
                    counts += count(held)
                    held, size = [], 0
            if held:
                counts += count(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a tokenizer file that every executor can open. ``cache`` is a folder in shared
    storage; counts lie in it by tokenizer version and content digest (SHA-256 of the text, null
    read as the empty text: any further normalisation could change a count). Counts found there
    are taken over, every other distinct text is encoded once, whole, and appended; equal texts
    are merged before they are shuffled, so a text that a third of all rows share costs one
    row per task. Without ``cache`` a new folder in the checkpoint folder is used.

    A run that is repeated after a lost write finds the counts that were appended, if any; two
    runs that append the same digest leave equal rows, which are read as one. Empty and null texts
    have 0 bytes and the tokenizer's count for the empty text. Repeated rows are all counted. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    if cache is None:
        unique = spark.range(1).select(F.expr("uuid()")).first()[0]
        cache = f"{shared_folder(spark)}/token-cache-{unique}"
    folder = f"{cache}/tokenizer={version}"

    def stored() -> DataFrame:
        try:
            kept = spark.read.schema(CACHE_SCHEMA).parquet(folder)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            kept = spark.createDataFrame([], CACHE_SCHEMA)
        return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    content = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(key).cast("long").alias("doc_id"), content.alias("content"))
    digest = F.unhex(F.sha2("content", 256))
    distinct = read.groupBy(digest.alias("digest")).agg(F.first("content").alias("content"))
    distinct = distinct.join(stored().select("digest"), "digest", "left_anti")
    distinct.mapInArrow(_encode(path, version), CACHE_SCHEMA).write.mode("append").parquet(folder)
    narrow = read.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), digest.alias("digest"))
    counted = narrow.join(stored(), "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
