"""Operator 4, SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words, each with the blank before it (see :mod:`rankfold.llm.unigram` for the model,
why a word may be taken alone, and the tie rules), and the words are encoded by themselves:

1. all substrings of a word that may be pieces are exploded: those of at most SHORT_PIECE characters, and up to the
   longest piece's length where a longer piece ends with the same characters; pieces that are always beaten by others in
   their place (:func:`rankfold.llm.unigram.winners`) are left out, since no best path has one;
2. they are joined to the piece table on equality (the vocabulary, of fixed size, is broadcast); a single
   character without a piece stays as an unknown one, whose bytes stand in the edge;
3. the edges are grouped by word, in the partitioning that the words have already;
4. a higher-order ``aggregate`` folds them, sorted by end and falling length, into the best path to each
   end, replacing a path only by a strictly better one, and a second one walks back.

Decoding joins ids to the bytes of their pieces, and reads the bytes as UTF-8.

Defined cases: null and empty texts have no words; a word is the string between two blanks, and a line
feed begins a word of its own (without a blank); repeated rows count again; an empty table gives an
empty result.  Work is linear in a word's length: long words are exploded block by block, edges carry
neither word nor text, and long folds are folds of short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm import unigram
from rankfold.llm.common import id_and_text, stored

#: Bytes of the words that are broadcast with their encodings: each is counted twice, with HOT_ROW bytes more.
HOT, HOT_ROW = 64 << 20, 96
#: The longest of them, in bytes.
HOT_WORD = 1024
#: Levels of frequency for each doubling, and parts of a level.
LEVELS, PARTS = 4, 64
#: Characters of a word that are exploded together, or walked back over in one fold.
BLOCK = 256
#: Edges of a fold.
STEPS = 1024
#: Characters of a piece that is looked up at every end.
SHORT_PIECE = 4
#: Bytes of the documents that a task encodes, up to this many tasks.
TASK_BYTES, TASKS = 1_600_000, 50_000


def words_of(text: Column) -> Column:
    """Words of a text: a word has the blank before it, unless it begins with a line feed."""
    return F.when(F.length(text) > 0, F.split(F.replace(text, F.lit("\n"), F.lit(" \n")), " "))


def unit_of(word: Column) -> Column:
    """The word as the model spells it."""
    return F.when(word.startswith("\n"), word).otherwise(F.concat(F.lit(unigram.BLANK), F.replace(word, F.lit(" "), F.lit(unigram.BLANK))))


def piece_table(spark: SparkSession, model_path: str) -> tuple[DataFrame, float, int, int]:
    pieces, unknown, byte0 = unigram.vocabulary(model_path)
    frame = spark.createDataFrame(pieces, "piece string, score double, id int")
    return frame, unknown, byte0, max(len(p) for p, _, _ in pieces)


def lattice(words: DataFrame, keys: list[str], model_path: str) -> DataFrame:
    """(keys, edges) for words (keys, word) that are partitioned by some of the keys.

    An edge is (end, minus_len, score, id); an unknown character's id is -1 less its UTF-8 bytes as a number.
    """
    won, unknown = unigram.winners(model_path)
    pieces, longest = words.sparkSession.createDataFrame(won, "piece string, score double, id int"), max(len(p) for p, _, _ in won)
    spelt = words.select(*keys, unit_of(F.col("word")).alias("unit"))
    # blocks, each with the characters before it that its pieces may begin at
    blocks = spelt.select(*keys, "unit", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1, F.lit(BLOCK))).alias("block")).select(
        *keys, "block", F.least(F.lit(longest - 1), F.col("block")).alias("skip"), F.least(F.lit(BLOCK), F.char_length("unit") - F.col("block")).alias("n"),
        F.substr("unit", F.greatest(F.lit(0), F.col("block") - (longest - 1)) + 1, F.lit(BLOCK + longest - 1)).alias("chars"))
    endings = sorted({p[-SHORT_PIECE:] for p, _, _ in won if len(p) > SHORT_PIECE})
    ending = F.substr("chars", F.greatest(F.lit(0), F.col("skip") + F.col("stop") - SHORT_PIECE) + 1, F.lit(SHORT_PIECE))
    most = F.when(ending.isin(endings), F.lit(longest)).otherwise(F.lit(SHORT_PIECE))
    parts = (blocks.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("stop"))
             .select("*", F.explode(F.sequence(F.lit(1), F.least(most, F.col("skip") + F.col("stop")))).alias("len"))
             .select(*keys, (F.col("block") + F.col("stop")).alias("end"), "len",
                     F.substr("chars", F.col("skip") + F.col("stop") - F.col("len") + 1, F.col("len")).alias("piece")))
    edges = parts.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR len = 1")
    character = -1 - F.conv(F.hex("piece"), 16, 10).cast("long")
    edge = F.struct("end", (-F.col("len")).alias("minus_len"), F.coalesce("score", F.lit(unknown)).alias("score"),
                    F.coalesce(F.col("id").cast("long"), character).alias("id"))
    return edges.select(*keys, edge.alias("edge")).groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def best_path(edges: Column, longest: int) -> Column:
    """For each end the last piece of its best path (element 0 stands for the start), as id * 2^bits + length.

    ``aggregate`` copies its state at every step, so a fold over all edges would be quadratic in the state.
    The inner fold goes over STEPS edges and holds their picks only; the outer one puts these together.
    """
    bits = longest.bit_length()
    state = lambda recent, picks, end, score, last: F.struct(
        recent.alias("recent"), picks.alias("picks"), end.alias("end"), score.alias("score"), last.alias("last"))
    none = F.array().cast("array<bigint>")
    start = state(F.array().cast("array<double>"), none, F.lit(0), F.lit(0.0), F.lit(0).cast("long"))
    pick = lambda e: F.shiftleft(e["id"], bits) - e["minus_len"]

    def fold(acc, e):
        scores = F.concat(F.when(F.size(acc["recent"]) < longest, acc["recent"]).otherwise(F.slice(acc["recent"], 2, longest)), F.array(acc["score"]))
        next_end = state(scores, F.array_append(acc["picks"], acc["last"]), e["end"], F.element_at(scores, e["minus_len"]) + e["score"], pick(e))
        score = F.element_at(acc["recent"], e["minus_len"]) + e["score"]
        better = state(acc["recent"], acc["picks"], acc["end"], score, pick(e))
        return F.when(e["end"] > acc["end"], next_end).when(score > acc["score"], better).otherwise(acc)

    def outer(acc, i):
        here = state(acc["recent"], none, acc["end"], acc["score"], acc["last"])
        return F.aggregate(F.slice(edges, i + 1, F.lit(STEPS)), here, fold, lambda new: state(
            new["recent"], F.concat(acc["picks"], new["picks"]), new["end"], new["score"], new["last"]))

    return F.aggregate(F.sequence(F.lit(0), F.size(edges) - 1, F.lit(STEPS)), start, outer, lambda acc: F.struct(
        F.array_append(acc["picks"], acc["last"]).alias("picks"), acc["score"].alias("score")))


def walk_back(picks: Column, longest: int) -> Column:
    """Ids of the best path; in two folds for the same reason."""
    bits, end = longest.bit_length(), F.size(picks) - 1
    state = lambda at, ids: F.struct(at.alias("at"), ids.alias("ids"))
    none = F.array().cast("array<bigint>")

    def step(acc, _):
        pick = F.get(picks, acc["at"])
        length = pick.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
        return F.when(acc["at"] == 0, acc).otherwise(state(acc["at"] - length, F.array_append(acc["ids"], F.shiftright(pick, bits))))

    def outer(acc, _):
        return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(BLOCK), end)), state(acc["at"], none), step,
                           lambda new: state(new["at"], F.concat(acc["ids"], new["ids"])))

    return F.aggregate(F.sequence(F.lit(1), end, F.lit(BLOCK)), state(end, none), outer, lambda acc: F.reverse(acc["ids"]))


def encode_words(words: DataFrame, keys: list[str], model_path: str) -> DataFrame:
    """(keys, score, ids) for words (keys, word) that are partitioned by some of the keys."""
    _, _, byte0, longest = piece_table(words.sparkSession, model_path)
    found = lattice(words, keys, model_path).select(*keys, best_path(F.col("edges"), longest).alias("best"))

    def spelt(i):
        digits = F.hex(-1 - i)
        return F.when(i >= 0, F.array(i.cast("int"))).otherwise(F.transform(
            F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda a: (F.conv(F.substr(digits, a, F.lit(2)), 16, 10).cast("int") + byte0)))

    return found.withColumn("path", walk_back(F.col("best.picks"), longest)).select(*keys, F.col("best.score").alias("score"), F.flatten(F.transform("path", spelt)).alias("ids"))


def encode_distinct(words: DataFrame, model_path: str) -> DataFrame:
    """Distinct words with their columns, score and ids; a word is known by its digest meanwhile."""
    keyed = words.withColumn("key", F.sha2("word", 256)).repartition("key")
    return keyed.join(encode_words(keyed.select("key", "word"), ["key"], model_path).hint("merge"), "key").drop("key")


def decode_ids(ids: Column, spark: SparkSession, model_path: str) -> Column:
    """The text that ids stand for, blanks as blanks, with the blank of the first piece."""
    pieces, _, byte0 = unigram.vocabulary(model_path)
    digits = [""] * (max(i for _, _, i in pieces) + 1)
    for piece, _, i in pieces:
        digits[i] = piece.replace(unigram.BLANK, " ").encode().hex()
    for b in range(256):
        digits[byte0 + b] = f"{b:02x}"
    table = F.split(F.lit(",".join(digits)), ",")  # folded into one constant of the size of the vocabulary
    return F.decode(F.unhex(F.concat_ws("", F.transform(ids, lambda i: F.get(table, i)))), "UTF-8")


def encode_vocabulary(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct word of all texts: word, n (occurrences), n_pieces, score, ids, decoded."""
    words = id_and_text(docs, id_col, text_col).select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    out = encode_distinct(words, model_path)
    return out.select("word", "n", F.size("ids").cast("long").alias("n_pieces"), "score", "ids",
                      decode_ids(F.col("ids"), docs.sparkSession, model_path).alias("decoded"))


def frequent_words(texts: DataFrame) -> DataFrame:
    """The most frequent words, as many as take at most :data:`HOT` bytes, whatever the texts are.

    Words are counted by themselves and stored; their bytes, added up by level of frequency and part of a level, tell
    the last part that is in.  A word that occurs once isn't: it is encoded once, wherever that is.
    """
    counted = texts.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = stored(counted.where((F.col("n") > 1) & (F.octet_length("word") <= HOT_WORD)), "counts")
    rank = -F.floor(F.log2("n") * LEVELS) * PARTS + F.pmod(F.xxhash64("word"), F.lit(PARTS))
    taken, last = 0, None
    for part, size in sorted(words.groupBy(rank.alias("part")).agg(F.sum(F.octet_length("word") * 2 + HOT_ROW)).collect()):
        if (taken := taken + size) > HOT:
            break
        last = part
    return words.where(rank <= F.lit(last)).select("word")


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_pieces, ids, decodes.  Rows with the same id and text are one row.

    ``decodes`` tells whether the ids read back are the text (after the blank that the first word gets);
    a text that holds the sign for a blank doesn't.  All three are null for a null text.

    Texts are exchanged once, by document.  Frequent words are encoded beforehand and broadcast (a bounded number
    of bytes); the others are encoded where they stand, and all lists are put together in the same partitions,
    so besides only each task's distinct words are exchanged, to count them.  Rows with the same id and text meet in one
    task, which reads them as a stream and keeps one.
    """
    spark = docs.sparkSession
    given = id_and_text(docs, id_col, text_col)
    n_bytes = given.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0
    hot = stored(encode_distinct(frequent_words(given), model_path).select("word", "ids"), "words")

    # a document's keys are never null, so that its lists can be joined
    keys = ["doc", "no_id", "h"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TASKS, n_bytes // TASK_BYTES))
    texts = given.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("h"), "text")
    texts = texts.repartition(parts, *keys).groupBy(*keys).agg(F.first("text").alias("text"))
    seen = texts.select(*keys, F.col("text").isNull().alias("none"), F.posexplode_outer(words_of(F.col("text"))).alias("at", "word"))
    place = F.when(F.col("ids").isNotNull(), F.struct("at", "ids"))
    known = seen.join(F.broadcast(hot), "word", "left")  # broadcast once, though read twice
    near = known.groupBy(*keys, "none").agg(F.collect_list(place).alias("near"))
    rare = known.where("word IS NOT NULL AND ids IS NULL").select(*keys, "at", "word")
    far = encode_words(rare, [*keys, "at"], model_path).groupBy(*keys).agg(F.collect_list(F.struct("at", "ids")).alias("far"))
    lists = near.join(far.hint("merge"), keys, "left")
    found = F.sort_array(F.when(F.col("far").isNull(), F.col("near")).otherwise(F.concat("near", "far")))
    whole = lists.withColumn("found", found).select(
        F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "h", F.when(~F.col("none"), F.flatten(F.transform("found", lambda x: x["ids"]))).alias("ids"))
    decoded = F.when(F.size("ids") == 0, "").otherwise(F.substr(decode_ids(F.col("ids"), spark, model_path), F.lit(2)))
    return whole.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_pieces"), "ids",
                        F.when(F.col("ids").isNotNull(), F.xxhash64(decoded) == F.col("h")).alias("decodes"))
