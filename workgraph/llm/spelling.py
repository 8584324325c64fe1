"""Spelling variants of a corpus' words by permuterm rotations.

A word is marked with a terminator and rotated to begin at every place. What stands before the end of a rotation and its last
letter are a prefix that names the rest of the word without that letter: ``b$a`` of ``a c b``. All words that differ in the one
letter ``c`` share the prefix (replacements), and the word without it is the prefix itself (indels). So the rotations sorted by
prefix have every near pair in one group, and a group holds at most one word for each letter of the alphabet and one more:
no group grows with the corpus.

A word's form is the near word that occurs most often, if at least twice as often; its root is found by following forms,
which doubles the steps in every round. Forms occur at least twice as often as their words, so chains are short and have no loops.

Null and empty texts have no words. A null id counts as ''. Every row is a text of its own, also a repeated one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workgraph.llm.registry import query
from workgraph.session import cut, scratch

#: Words have so many letters and occurrences at least; a form occurs so many times as often as its word.
LETTERS, LEAST, TIMES = 5, 3, 2
#: A letter goes from a run whose hash this divides.
EVERY = 97
#: Runs a task adds up before it hands them on, and characters it reads at a time.
HELD, PIECE = 400_000, 1 << 20
#: The letters as single bytes (a letter's code point is its byte), A-Z in lower case, everything else blank.
RUNS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str | None) -> Counter[bytes]:
    """The text's maximal runs of letters with their numbers, one byte a letter; long texts are read piece by piece."""
    found: Counter[bytes] = Counter()
    text = text or ""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and (("A" <= (c := text[end]) <= "Z") or "a" <= c <= "z" or "À" <= c <= "ÿ"):
            end += 1
        found.update(text[at:end].encode("latin-1", "replace").translate(RUNS).split())
        at = end
    return found


def altered(run: bytes, seed: int) -> bytes:
    """The run, without one letter where its hash asks for that; ``seed`` is the hash of what stands before it."""
    code = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if code % EVERY:
        return run
    place = code % len(run)
    return run[:place] + run[place + 1:]


def words(docs: DataFrame, id: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""
    plain = docs.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for at in range(0, len(names), 20_000):
                some = names[at:at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in some], pa.string()), pa.array([held[w] for w in some], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text")):
                seed = zlib.crc32(f"{i}:".encode())
                for run, n in runs(t.as_py()).items():
                    if len(run) >= letters and len(word := altered(run, seed)) >= letters:
                        held[word] += n
            if len(held) > HELD:
                yield from flush()
        yield from flush()

    return plain.mapInArrow(read, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def rotations(found: DataFrame) -> DataFrame:
    """(prefix, letter, first, word, n): every rotation of a word as a prefix, whole (no letter) and without its last letter.

    ``first`` says that the skipped letter differs from the one before it, so a letter skipped from a run of equal ones counts once.
    """
    whole = F.expr("transform(sequence(0, length(word)), i -> struct(concat(substring(word, i + 1), '$', substring(word, 1, i)) AS prefix, "
                   "CAST(NULL AS STRING) AS letter, true AS first))")
    skipped = F.expr("transform(sequence(1, length(word)), i -> struct(concat(substring(word, i + 1), '$', substring(word, 1, i - 1)) AS prefix, "
                     "substring(word, i, 1) AS letter, i = 1 OR substring(word, i, 1) != substring(word, i - 1, 1) AS first))")
    return found.select("word", "n", F.explode(F.concat(whole, skipped)).alias("_r")).select("_r.*", "word", "n")


def neighbours(found: DataFrame) -> DataFrame:
    """(word, near, near_n): every word with every near word, once."""
    groups = rotations(found).groupBy("prefix").agg(F.collect_list(F.struct("letter", "first", "word", "n")).alias("_g")).filter(F.size("_g") > 1)
    near = F.expr("filter(_g, y -> y.word != _x.word AND (y.letter IS NOT NULL AND _x.letter IS NOT NULL OR y.letter IS NULL AND _x.first OR _x.letter IS NULL AND y.first))")
    return groups.select("_g", F.explode("_g").alias("_x")).select(F.col("_x.word").alias("word"), F.explode(near).alias("_y")) \
        .select("word", F.col("_y.word").alias("near"), F.col("_y.n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the forms that follow; each round doubles the steps."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = cut(steps.join(beyond.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        steps = longer.select("word", "root")
        if longer.filter("_moved").isEmpty():
            return steps


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words."""
    with scratch() as held:
        return held.keep(cut(_variants(docs, id, text, letters, least)))


def _variants(docs: DataFrame, id: str, text: str, letters: int, least: int) -> DataFrame:
    found = cut(words(docs, id, text, letters, least))
    # The largest count, then the smallest word in code-point order, which is the order of its bytes.
    best = F.min(F.struct((-F.col("near_n")).alias("_order"), "near"))
    summed = neighbours(found).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    enough = -F.col("_best._order") >= TIMES * F.col("n")
    judged = cut(found.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("_best.near")).alias("form"), F.when(enough, -F.col("_best._order")).alias("form_n")))
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


@query("op12_spelling_variants")
def op12(spark, read):
    return variants(read("documents").select("doc_id", "text"))
