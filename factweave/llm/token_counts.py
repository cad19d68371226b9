"""Token counts of whole texts by counting the pieces of each distinct pre-token once."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import map_rows, record, stash, text_of

#: Pre-tokens whose counts travel with the tasks, and the bytes of each of these at most; all others are joined.
HOT, SHORT = 100_000, 64
#: The model writes a space as this character, so it means a space in a text too.
_SPACE = "▁"
#: A pre-token starts at a run of spaces or at a line break; no piece of the model reaches across one.
_PRETOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, whose piece counts add up to the text's.

    Each is written without its first space, so ``w`` stands for a space and ``w``; one that starts
    with a line break has no space. The model puts a space before the text.
    """
    if not text:
        return []
    if _SPACE in text:
        text = text.replace(_SPACE, " ")
    plain = text.replace("\n", " \n").split(" ")
    if "" not in plain:
        return plain
    return [x[1:] if x[0] == " " else x for x in _PRETOKEN.findall(" " + text)]


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits_at_spaces(path: str) -> bool:
    """Whether counting by pre-token is exact for a model: no piece goes on after a space or holds a line break."""
    model = load_model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return not any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces)


def piece_counts(model, keys: list[str]) -> list[int]:
    """Pieces of each pre-token. The model adds a space before what it encodes, which before a line break is one piece of its own."""
    found = [len(ids) for ids in model.encode(keys, num_threads=1)]
    return [1 if not k else n - 1 if k[0] == "\n" else n for k, n in zip(keys, found, strict=True)]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, hot: int = HOT) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every whole text, without its ids ever being made.

    1. Distinct pre-tokens with their corpus counts, combined where they are read.
    2. Pieces of each distinct pre-token, counted once by the model.
    3. The commonest of up to ``SHORT`` bytes, ``hot`` at most (so their size is bounded), go to every task as a table;
       a document's frequencies of these are summed where it is read. They are also the keys that
       would be skewed. All other frequencies are joined to the counts by pre-token and summed by
       document.

    A very long text is one row like any other; without spaces it is one pre-token, joined like all
    long ones. A null text counts as empty and has no tokens; rows with the same id are separate documents; an
    empty table gives no rows; other columns are ignored.
    """
    if not splits_at_spaces(model_path):
        raise ValueError("a piece of this model reaches across pre-tokens")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    def distinct():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(pretokens(text))
            return record(key=pa.array(seen.keys(), pa.string()), n=pa.array(seen.values(), pa.int64()))

        return apply

    def counted():
        model = load_model(model_path)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            pieces = piece_counts(model, batch.column(0).to_pylist())
            return record(key=batch.column(0), n=batch.column(1), pieces=pa.array(pieces, pa.int64()))

        return apply

    keys = map_rows(texts.select("text"), distinct, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = stash(map_rows(keys, counted, "key string, n long, pieces long"))
    level = F.floor(F.log2("n") * 16).cast("int")  # so few levels that their sizes fit in one row each
    short = keys.filter(F.octet_length("key") <= SHORT)
    least, taken = 0, 0
    for r in sorted(short.groupBy(level.alias("level")).agg(F.count("*").alias("n_keys")).collect(), reverse=True):
        taken += r.n_keys
        if taken > hot:
            least = r.level + 1
            break
    top = short.filter(level >= least).select("key", "pieces").collect()  # hot rows of SHORT bytes at most
    shared = texts.sparkSession.sparkContext.broadcast({r.key: r.pieces for r in top})

    def summed():
        get = shared.value.get

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, sums, ends, keys, times = [], [], [0], [], []
            for text in batch.column(1).to_pylist():
                words = pretokens(text)
                found = list(map(get, words))
                unknown = found.count(None)
                if unknown:
                    rest = Counter(w for w, n in zip(words, found, strict=True) if n is None)
                    keys += rest.keys()
                    times += rest.values()
                ends.append(len(keys))
                sums.append(sum(n for n in found if n is not None) if unknown else sum(found))
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
            cold = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64())], ["key", "n"]))
            return record(id=batch.column(0), n_bytes=pa.array(sizes, pa.int64()), hot_tokens=pa.array(sums, pa.int64()), cold=cold)

        return apply

    rows = map_rows(texts, summed, "id long, n_bytes long, hot_tokens long, cold array<struct<key: string, n: long>>")
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()))
    cold = rows.select("row", F.inline("cold")).join(keys.select("key", "pieces"), "key")
    cold = cold.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("cold_tokens"))
    total = F.col("hot_tokens") + F.coalesce("cold_tokens", F.lit(0))
    return rows.select("row", "id", "n_bytes", "hot_tokens").join(cold, "row", "left").select(F.col("id").alias(id_col), "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
