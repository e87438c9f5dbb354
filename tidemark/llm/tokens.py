"""Token counts without tokenizing every word.

A vocabulary string that encodes, standing alone, as just its own token costs one token wherever
it stands as a whole word: that is proved once, offline, for the whole vocabulary.  Words found in
the proved set count as one; only the others are merged by the tokenizer, once per distinct word
and worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted

SPACE = "▁"
RUN = re.compile(r" +[^ ]+")
MERGED_WORDS = 300_000  # distinct merged words a worker remembers before it starts afresh


class PieceCounter(dict):
    """Token count of a word with the space mark before it; itself the memory of merged words.

    No piece holds the space mark after another character, so no merge crosses the start of a
    word, and counts of words add up to the count of the text.  A vocabulary or normalizer for
    which that does not hold (checked here) is always encoded whole.
    """

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        super().__init__()
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = model_pb2.ModelProto.FromString(self.encoder.serialized_model_proto())
        spec = model.normalizer_spec
        pieces = [p for p in model.pieces if p.type == p.NORMAL]
        self.separable = (
            spec.name == "identity" and spec.escape_whitespaces and spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == p.USER_DEFINED for p in model.pieces)
            and not any(SPACE in p.piece.lstrip(SPACE) for p in pieces))
        self.whole = self._proved([p.piece for p in pieces])
        self.update(self.whole)

    def _proved(self, pieces: list[str]) -> dict[str, int]:
        """Words whose marked form is one vocabulary string and encodes as that one token."""
        words = [p[1:] for p in pieces if p.startswith(SPACE) and p[1:] and SPACE not in p[1:]]
        return {w: 1 for w, ids in zip(words, self.encoder.encode(words, num_threads=1))
                if len(ids) == 1 and self.encoder.id_to_piece(ids[0]) == SPACE + w}

    def __missing__(self, word: str) -> int:
        if len(self) > MERGED_WORDS + len(self.whole):
            self.clear()
            self.update(self.whole)
        n = self[word] = len(self.encoder.encode(word))
        return n

    def count(self, text: str) -> int:
        if not self.separable or SPACE in text or text[-1:] in ("", " "):
            return len(self.encoder.encode(text, num_threads=1))
        words = text.split(" ")
        if "" in words:  # a run of spaces goes with the word behind it
            words = [unit[1:] for unit in RUN.findall(" " + text)]
        return sum(map(self.__getitem__, words))


def count_tokens(docs: DataFrame, model_file: str, id_column: str = "doc_id", text: str = "text",
                 limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row; no shuffle.

    Null and empty texts have no bytes and no tokens; repeated rows are counted each; an empty
    table gives an empty table; other columns are not read.  Long texts are counted whole.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([counter.count(t) for t in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"), body.alias("body"),
                       F.octet_length(body).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
