"""Spelling variants: words one code point apart, found through an index of variable-length grams.

A gram of SHORTEST characters or more is frequent if it stands at more than one in PLACES of all
places in the vocabulary; fewer than PLACES grams of each length can be, so the dictionary has a
fixed bound and is sent to every task. From each place of a word (with a mark at either end) goes
its longest frequent gram, made longer by one character up to LONGEST, unless a gram from an
earlier place covers it.

An edit leaves all grams of a word as they are but those that overlap it, and those next to it
that a longer gram through the edit could replace. The most grams any one edit affects is the
word's bound: a near word shares all grams but that many, so it must stand in the list of one of
the word's bound + 1 rarest grams. Lists are kept by gram, place and length of the word, and an
edit moves a gram by one place at most. Where an edit could affect every gram a word has, what
the edit leaves of the word is one more entry of the index. All words that meet in a list are
verified by their edit distance.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import id_and_text, settled
from scoreloom.session import small_side

MIN_LENGTH, MIN_COUNT = 5, 3
# A variant's form is at least so many times as frequent.
RATIO = 2
SHORTEST, LONGEST = 2, 6
PLACES = 16384
# Marks of a word's beginning and end.
BEGIN, END = "\x02", "\x03"
# Words in one list that meet in one task.
HOT = 4096
# One in this many runs of a document loses a code point.
DROPPED = 97
# Distinct words a task adds up before it passes them on.
HELD = 200_000

# In Latin-1, which has one byte for each letter: A-Z lowered, a-z and U+00C0 to U+00FF kept, the rest a gap.
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256)
)


def runs(text: bytes | None) -> list[bytes]:
    """Runs of letters, lower-cased, in Latin-1; whatever Latin-1 lacks is a gap."""
    return (text or b"").decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def count_words(
    docs: DataFrame, dropped: int | None = DROPPED, min_length: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n) over all texts; in one of `dropped` runs of a document, chosen by crc32, a code point is deleted."""

    def out(held: Counter) -> pa.RecordBatch:
        found = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= min_length and n]
        return pa.RecordBatch.from_pydict({"word": pa.array([w for w, _ in found], pa.string()), "n": pa.array([n for _, n in found], pa.int64())})

    def work(batches):
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = runs(text.as_py())
                held.update(words)
                if dropped:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    crc = zlib.crc32
                    for word in [w for w in set(words) if not crc(w if w.isascii() else _utf8(w), start) % dropped]:
                        n, at = words.count(word), crc(_utf8(word), start) % len(word)
                        held[word] -= n
                        held[word[:at] + word[at + 1 :]] += n
                if len(held) > HELD:
                    yield out(held)
                    held = Counter()
        yield out(held)

    counted = id_and_text(docs, id_col, text_col).mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Dictionary:
    """The frequent grams and how often each stands in the vocabulary."""

    def __init__(self, counts: dict[str, int], longest: int = LONGEST):
        self.counts, self.longest = counts, longest

    def grams(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of a word's variable-length grams, both ascending."""
        out, reach, known = [], 0, self.counts
        for a in range(len(word) - SHORTEST + 1):
            b = a + SHORTEST
            while b < len(word) and b - a < self.longest and word[a:b] in known:
                b += 1
            if b > reach:
                out.append((a, b))
                reach = b
        return out

    def _before(self, word: str, p: int) -> int:
        """From where on a longer gram might reach over p."""
        j = p
        while j > 0 and p - j + 1 < self.longest and (p - j + 1 < SHORTEST or word[j - 1 : p] in self.counts):
            j -= 1
        return j

    def _after(self, word: str, q: int) -> int:
        """Up to where a longer gram from before q might reach."""
        k = q
        while k < len(word) and k + 1 - q < self.longest and (k - q < SHORTEST or word[q:k] in self.counts):
            k += 1
        return k

    def entries(self, plain: str) -> tuple[list[tuple[str, int]], list[str]]:
        """The grams (with places) under which a word is listed and looked up, and the remainders of edits that leave no gram."""
        word = BEGIN + plain + END
        n, grams = len(word), self.grams(word)
        starts, ends = [a for a, _ in grams], [b for _, b in grams]
        # Grams that end by a place, and those that begin before it.
        done = [bisect_right(ends, x) for x in range(n + 1)]
        begun = [bisect_left(starts, x) for x in range(n + 1)]
        before = [min(done[p], begun[self._before(word, p)]) for p in range(n + 1)]
        after = [len(grams) - max(begun[q], done[self._after(word, q)]) for q in range(n + 1)]
        least, bare = len(grams), set()
        for p in range(1, n):
            for q in (p, p + 1):
                if q < n:
                    left = before[p] + after[q]
                    least = min(least, left)
                    if not left:
                        bare.add(word[:p] + word[q:])
        known = self.counts
        listed = [(known.get(word[a:b], 0), word[a:b], a) for a, b in grams]
        listed.sort()
        if least > 0:
            listed = listed[: len(grams) - least + 1]
        return [(gram, a) for _, gram, a in listed], sorted(bare)


def frequent_grams(vocabulary: DataFrame, places: int = PLACES, longest: int = LONGEST) -> Dictionary:
    """Grams at more than one in `places` of all places; each length is counted only where both its parts are frequent."""
    spark = vocabulary.sparkSession
    total = vocabulary.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    least = total // places + 1
    counts: dict[str, int] = {}
    for length in range(SHORTEST, longest):
        shared = spark.sparkContext.broadcast(counts)

        def work(batches, length=length, shared=shared):
            known, found = shared.value, Counter()
            for batch in batches:
                for plain in batch.column(0).to_pylist():
                    word = BEGIN + plain + END
                    for a in range(len(word) - length + 1):
                        gram = word[a : a + length]
                        if length == SHORTEST or (gram[1:] in known and gram[:-1] in known):
                            found[gram] += 1
            yield pa.RecordBatch.from_pydict({"gram": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        found = vocabulary.select("word").mapInArrow(work, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        new = {r["gram"]: r["n"] for r in found.where(F.col("n") >= least).collect()}
        if not new:
            break
        counts = counts | new
    return Dictionary(counts, longest)


def _key(gram: str, place: int, length: int) -> int:
    return xxhash.xxh64_intdigest(f"{place}/{length}/{gram}".encode()) - (1 << 63)


def _indexed(vocabulary: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Words with the keys under which they are listed (homes) and those of lists of longer words they look into (guests)."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(dictionary)

    def work(batches):
        for batch in batches:
            homes, guests, letters = [], [], []
            for word in batch.column(0).to_pylist():
                grams, bare = shared.value.entries(word)
                n = len(word)
                homes.append([_key(g, a, n) for g, a in grams] + [_key(r, -1, 0) for r in bare])
                guests.append([_key(g, a + k, n + 1) for g, a in grams for k in (0, 1)])
                mask = 0
                for c in set(word):
                    mask |= 1 << ord(c) % 31
                letters.append(mask)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(letters, pa.int32()), pa.array(homes, kind), pa.array(guests, kind)],
                names=["word", "n", "letters", "homes", "guests"],
            )

    return vocabulary.mapInArrow(work, "word string, n long, letters int, homes array<long>, guests array<long>")


def near_words(vocabulary: DataFrame, places: int = PLACES, longest: int = LONGEST) -> DataFrame:
    """(word, other, n) for every two words that are one edit apart, both ways round; n is the other's count.

    A list of more than HOT words is dealt out: its words look it up in parts, each of which
    meets the whole list in a task of its own. What meets is compared at once (first by the
    letters both have, then by edit distance); only near pairs leave the join.
    """
    index = settled(_indexed(vocabulary, frequent_grams(vocabulary, places, longest)))
    listed = index.select(F.explode("homes").alias("key"), "word", "n", "letters")
    asking = index.select(F.explode("guests").alias("key"), "word", "n", "letters")
    hot = settled(
        listed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > HOT)
        .select("key", F.ceil(F.col("size") / HOT).cast("int").alias("parts"))
    )
    left = listed.withColumn("guest", F.lit(False)).unionByName(asking.withColumn("guest", F.lit(True)))
    right = listed
    if hot.isEmpty():
        left, right = left.withColumn("part", F.lit(0)), right.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        hot = small_side(hot)
        left = left.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int")).drop("parts")
        right = right.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    a, b = left.alias("a"), right.alias("b")
    meet = (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.part") == F.col("b.part"))
        & (F.col("a.guest") | (F.col("a.word") < F.col("b.word")))
        & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2)
        & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
    )
    pairs = a.join(b, meet).select(
        F.col("a.word").alias("word"), F.col("a.n").alias("own"), F.col("b.word").alias("other"), F.col("b.n").alias("n")
    )
    both = pairs.select("word", "other", "n").union(pairs.select("other", "word", "own"))
    # Brought together by word, which serves both this and what is asked of each word's near words.
    return both.repartition("word").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form. A form is more frequent than its word, so paths end; they are halved each round."""
    reach = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        reach = settled(
            reach.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        )
        if reach.where("moved").isEmpty():
            return reach.select("word", "root")
        reach = reach.select("word", "root")


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, places: int = PLACES, longest: int = LONGEST) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word (of equal ones the first in code-point order) if
    that is at least `ratio` (2 or more, else forms could go in circles) times as frequent; root is
    where forms lead to, the word itself if it has none. A word has few near words (at most the
    letters there are, at each of its places), so they are gathered by word. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("forms of ratio 1 can go in circles")
    near = near_words(vocabulary, places, longest).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("least"), "other")).alias("best")
    )
    placed = settled(
        vocabulary.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(-F.col("best.least") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.least")).alias("form_n"))).alias("to"),
        )
    )
    roots = _roots(placed.where("to IS NOT NULL").select("word", F.col("to.form").alias("form")))
    return placed.join(roots, "word", "left").select(
        "word", F.col("to.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("to.form_n").alias("form_n")
    )


def spelling_variants(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, dropped: int | None = DROPPED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`group_variants` of the words of all texts with at least `min_length` code points and `min_count` occurrences.

    Null and empty texts have no words; a row without id counts with an empty id; repeated rows
    count each time. Other columns are not read.
    """
    words = count_words(docs, dropped, min_length, id_col, text_col)
    return group_variants(settled(words.where(F.col("n") >= min_count)))
