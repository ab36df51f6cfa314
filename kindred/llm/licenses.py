"""Licence scans with a positional index of rare words.

Every template is a list of words, some runs of which are mandatory. Over all files it is counted how
many hold each of the templates' words. The index has the postings (template, position) of the rare
words: those that few files hold, and of each template at least a few of its rarest. Of a file, the
licence words of highest IDF are looked up; their postings are intersected by relative position, so
that they vote for (template, start). What enough words agree on is verified: the mandatory runs
must stand there, and the share of the template's words in place is the score. A base phrase is
looked up by its rarest word in every file, and one word is enough: its places are found all.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import table, text_or_empty
from kindred.llm.notices import BASE, NOTICES

#: Lower-cased bytes of a word: digits, letters, and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words that at most this share of the files hold are rare; of each template at least so many words of highest IDF are indexed.
COMMON, RARE = 0.02, 4
#: A file's licence words that are looked up, those of highest IDF.
LOOKED_UP = 32
#: So many of them must agree on a start (all of a template's indexed words, if it has fewer).
AGREE = 2


def words_of(text: str) -> list[bytes]:
    """The words of a text after lower-casing A-Z only."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    #: (place, words) of the runs that must stand whole.
    needs: tuple[tuple[int, tuple[bytes, ...]], ...]
    base: bool

    def stands(self, words: list[bytes], start: int) -> bool:
        """Whether the mandatory runs are there, if the template began at that word."""
        return all(start + at >= 0 and tuple(words[start + at : start + at + len(run)]) == run for at, run in self.needs)


def templates(base: dict[str, str] = BASE, notices: dict[str, tuple[str, tuple[str, ...]]] = NOTICES) -> list[Template]:
    out = []
    for label, phrase in base.items():
        words = tuple(words_of(phrase))
        out.append(Template(label, words, ((0, words),), True))
    for label, (notice, phrases) in notices.items():
        words = tuple(words_of(notice))
        runs = [tuple(words_of(p)) for p in phrases]
        out.append(Template(label, words, tuple((next(i for i in range(len(words)) if words[i : i + len(r)] == r), r) for r in runs), False))
    return out


def document_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """How many files there are, and how many hold each word of the (fixed, small) vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, Counter()
        for batch in batches:
            for text in batch.column(0):
                n += 1
                held.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *held], pa.binary()), "n": pa.array([n, *held.values()], pa.int64())})

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts.pop(b"", 0), counts


class Index:
    """Postings of the templates' rare words."""

    def __init__(self, known: list[Template], files: int, counts: dict[bytes, int], rare: int = RARE, agree: int = AGREE, looked_up: int = LOOKED_UP) -> None:
        self.known, self.agree, self.looked_up = known, [], looked_up
        idf = {w: math.log((1 + files) / (1 + counts.get(w, 0))) for t in known for w in t.words}
        least = -math.log(COMMON)
        self.rank = {w: i for i, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.anchors: set[bytes] = set()
        for t, template in enumerate(known):
            best = sorted(set(template.words), key=self.rank.get)
            chosen = set(best[:1]) if template.base else set(best[:rare]) | {w for w in best if idf[w] >= least}
            if template.base:
                self.anchors |= chosen
            self.agree.append(min(agree, len(chosen)))
            for place, word in enumerate(template.words):
                if word in chosen:
                    self.postings[word].append((t, place))
        self.postings = dict(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words in place) of all verified places; a notice may be cut at either end."""
        there = self.postings.keys() & set(words)
        if not there:
            return []
        chosen = set(heapq.nsmallest(self.looked_up, there, key=self.rank.get)) | (self.anchors & there)
        votes = defaultdict(set)
        for i, word in enumerate(words):
            if word in chosen:
                for t, place in self.postings[word]:
                    votes[t, i - place].add(word)
        found = []
        for (t, start), agreed in votes.items():
            template = self.known[t]
            if len(agreed) >= self.agree[t] and template.stands(words, start):
                same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template.words))
                found.append((t, start, same / len(template.words)))
        return sorted(found)


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, tuple[str, tuple[str, ...]]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences of every row, as the columns of ``FOUND``.

    n_base counts all places of base phrases, first_word and last_word are the least and greatest
    word numbers of their starts (null if none). A null text counts as empty: no words, no labels
    (empty strings), score 0. Null ids and repeated rows are scanned like any other; texts of any
    length are read whole, by one task each; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    known = templates(base, notices)
    index = Index(known, *document_counts(rows, frozenset(w for t in known for w in t.words)))
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in FOUND.split(", ")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = index.scan(words)
                starts = [start for t, start, _ in found if known[t].base]
                own = {known[t].label for t, _, _ in found if known[t].base}
                out.append((key, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {known[t].label for t, _, _ in found})), max((s for _, _, s in found), default=0.0)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(find, FOUND)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
