"""Chunks packed greedily from a text's sections, each with the tail of what goes before it.

What a chunk holds depends on all chunks before it, so a text is one fold. It runs over words' counts in a task, once
through the text's pieces; sections come from built-in functions, and texts never meet one another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.structure import pieces_by_marker

#: Tokens for each word, and words of a tail before it is cut to its tokens.
PER_WORD, TAIL_WORDS = 1.3, 30
PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")


def token_count(text: Column) -> Column:
    """Tokens of a text where no tokenizer is at hand: 1.3 for each word, rounded down."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.floor(F.size(F.split(trimmed, r"\s+")) * F.lit(PER_WORD))).cast("int")


def cost(words: int) -> int:
    return int(words * PER_WORD)


@dataclass
class Packer:
    """The chunks of one text so far, with their numbers of words; the open chunk's pieces; the last chunk's tail."""

    least: int
    most: int
    overlap: int
    chunks: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    open: list[str] = field(default_factory=list)
    words: int = 0
    tail: list[str] = field(default_factory=list)

    def put(self, text: str, words: int) -> None:
        self.chunks.append(text)
        self.sizes.append(words)

    def add(self, piece: str, words: int) -> bool:
        """Adds a piece to the open chunk if it fits."""
        fits = cost(self.words + words) <= self.most
        if fits:
            self.open.append(piece)
            self.words += words
        return fits

    def close(self, merge: bool = False) -> None:
        """Ends the open chunk; one that is too small is lost, or, with merge, joins the last chunk where it fits."""
        if self.words and cost(self.words) >= self.least:
            self.put(" ".join(self.open), self.words)
        elif self.words and merge and self.chunks and cost(self.sizes[-1] + self.words) <= self.most:
            self.chunks[-1] = " ".join([self.chunks[-1], *self.open])
            self.sizes[-1] += self.words
        self.open, self.words = [], 0

    def remember(self, text: str) -> None:
        self.tail = text.split()[-TAIL_WORDS:][: int(self.overlap / PER_WORD)]

    def small(self, section: str, words: int) -> None:
        before = self.tail if self.tail and cost(len(self.tail) + words) <= self.most else []
        self.put(" ".join([*before, section]), len(before) + words)
        self.remember(section)

    def large(self, section: str) -> None:
        self.open, self.words = ([" ".join(self.tail)], len(self.tail)) if self.tail else ([], 0)
        for paragraph in filter(None, map(str.strip, PARAGRAPH.split(section))):
            if self.add(paragraph, len(paragraph.split())):
                continue
            self.close()
            for sentence in SENTENCE.split(paragraph):
                words = sentence.split()
                if self.add(sentence, len(words)):
                    continue
                self.close()
                if cost(len(words)) > self.most:
                    cut = words[: int(self.most / PER_WORD)]
                    self.put(" ".join(cut), len(cut))
                else:
                    self.add(sentence, len(words))
        self.close(merge=True)
        if self.chunks:
            self.remember(self.chunks[-1])

    def pack(self, sections: list[str]) -> list[str]:
        for section in sections:
            words = len(section.split())
            self.small(section, words) if cost(words) <= self.most else self.large(section)
        return [c for c in self.chunks if c.strip()]


def packed(docs: DataFrame, least: int = 80, most: int = 300, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index from 0, text, token_count): the chunks of each text (doc_id, text).

    A section of up to `most` tokens is a chunk, with the tail of the section before it where both fit. A longer one is
    packed from its paragraphs, a paragraph that doesn't fit from its sentences, and a sentence of more than `most`
    tokens is cut there. An open chunk of less than `least` tokens is dropped where a longer piece ends it, and joins the
    last chunk at the section's end. Null and blank texts have no chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sections in enumerate(batch.column("sections")):
                made = Packer(least, most, overlap).pack(sections.as_py())
                if made:
                    own = pa.repeat(batch.column("doc_id")[i], len(made))
                    yield pa.RecordBatch.from_arrays([own, pa.array(range(len(made)), pa.int32()), pa.array(made, pa.string())], names=["doc_id", "chunk_index", "text"])

    sections = docs.where("text is not null").select("doc_id", pieces_by_marker(F.col("text")).alias("sections"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = sections.where("size(sections) > 0").mapInArrow(run, f"doc_id {kind}, chunk_index int, text string")
    return out.withColumn("token_count", token_count(F.col("text")))
