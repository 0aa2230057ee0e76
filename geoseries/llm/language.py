"""Language identification by cross-parsing entropy over suffix automata.

Each language's automaton accepts every substring of a sample of its labelled text. A text is cut into phrases, each
the longest match from where the last one ended; the language that needs the fewest phrases per character (weighted by
the logarithm of its sample's length) wins. The sample is bounded: about `sample_chars` characters per language, of
documents drawn by hash of the id. Texts to be labelled are read whole. Every labelled language is learned; its table takes
some 45 MB in a worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.llm.common import rows_of, text_or_empty

#: Characters of labelled text per language that its automaton is built from.
SAMPLE_CHARS = 60_000
#: Letters with a symbol of their own, by frequency in the samples; rarer ones share one symbol.
LETTERS = 125
#: Texts are parsed in pieces of so many characters, side by side; a phrase does not cross from one into the next.
PIECE = 1024
UNKNOWN = "und"
#: Sharpness of `score`: what one bit per character of difference means, in halvings.
SHARPNESS = 8.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


class Alphabet:
    """Maps characters to symbols: 0 for what is no letter (runs collapse), 1 for rare letters, then one each."""

    def __init__(self, samples: list[str]):
        counts: dict[str, int] = {}
        for sample in samples:
            for c in sample.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        kept = sorted(counts, key=lambda c: (-counts[c], c))[:LETTERS]
        self.symbols = {ord(c): i + 2 for i, c in enumerate(kept)}
        self.size = len(kept) + 2
        self.table = np.zeros(0x110000, np.uint8)

    def built(self) -> Alphabet:
        """Fill the table of letters, once per worker (the object is sent without it)."""
        if not self.table.any():
            self.table = np.array([chr(i).isalpha() for i in range(0x110000)], np.uint8)
            for point, symbol in self.symbols.items():
                self.table[point] = symbol
        return self

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text, with one 0 for every run of other characters between letters."""
        found = self.built().table[code_points(text)]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        found = found[keep]
        if len(found) and found[0] == 0:
            found = found[1:]
        return found[:-1] if len(found) and found[-1] == 0 else found

    def __getstate__(self):
        return {"symbols": self.symbols, "size": self.size}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.table = np.zeros(0x110000, np.uint8)


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of `sequence`; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for symbol in sequence:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in step[state]:
            step[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = step[state][symbol]
            if length[state] + 1 == length[target]:
                link[new] = target
            else:
                copy = len(step)
                step.append(dict(step[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state >= 0 and step[state].get(symbol) == target:
                    step[state][symbol] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return step


class CrossParser:
    """A language's automaton as one table: state and symbol to the next state, its sign telling that a phrase ended."""

    def __init__(self, sequence: list[int], symbols: int):
        step = suffix_automaton(sequence)
        unseen = len(step)  # a symbol the sample lacks is a phrase of its own
        table = np.zeros((len(step) + 1, symbols), np.int32)
        first = step[0]
        for symbol in range(symbols):  # no match: a phrase ends, the next one starts with this symbol
            table[:, symbol] = ~first.get(symbol, unseen)
        table[0] = unseen
        for state, targets in enumerate(step):
            for symbol, target in targets.items():
                table[state, symbol] = target
        self.table, self.symbols, self.length = table.ravel(), symbols, len(sequence)

    def phrases(self, pieces: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each piece. `pieces` holds a row per place and a column per piece, longest pieces first."""
        state = np.zeros(len(sizes), np.int64)
        count = np.zeros(len(sizes), np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, len(pieces) + 1), side="right")
        for place, many in enumerate(active):
            found = self.table[state[:many] * self.symbols + pieces[place, :many]]
            ended = found < 0
            count[:many] += ended
            state[:many] = np.where(ended, ~found, found)
        return count + (sizes > 0)


class Model:
    """Parsers of all languages; `predict` labels texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.alphabet = Alphabet([t for v in samples.values() for t in v])
        self.samples = {}
        for language in self.languages:
            coded = [self.alphabet.encode(t) for t in samples[language]]
            self.samples[language] = np.concatenate([np.append(c, np.uint8(0)) for c in coded]) if coded else np.zeros(0, np.uint8)
        self.parsers: list[CrossParser] | None = None

    def __getstate__(self):
        return self.__dict__ | {"parsers": None}

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; `und` with score 0 where there is no letter or nothing was learned."""
        if self.parsers is None:
            self.parsers = [CrossParser(self.samples[v].tolist(), self.alphabet.size) for v in self.languages]
        coded = [self.alphabet.encode(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [-(-len(c) // PIECE) for c in coded])
        cut = [c[i : i + PIECE] for c in coded for i in range(0, len(c), PIECE)]
        if not cut or not self.parsers:
            return [(UNKNOWN, 0.0)] * len(texts)
        sizes = np.array([len(c) for c in cut])
        order = np.argsort(-sizes, kind="stable")
        pieces = np.zeros((sizes.max(), len(cut)), np.uint8)
        for column, i in enumerate(order):
            pieces[: sizes[i], column] = cut[i]
        lengths = np.bincount(owner, sizes, len(texts))
        bits = np.empty((len(self.parsers), len(texts)))
        for k, parser in enumerate(self.parsers):
            phrases = np.bincount(owner[order], parser.phrases(pieces, sizes[order]), len(texts))
            bits[k] = phrases * np.log2(max(parser.length, 2)) / np.maximum(lengths, 1)
        best = bits.argmin(0)
        weights = np.exp2(-SHARPNESS * (bits - bits.min(0)))
        score = 1 / weights.sum(0)
        return [(self.languages[b], float(s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best, score, lengths)]


def draw_samples(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Texts per language, in order of the hash of their id, until `sample_chars` characters are reached.

    `labelled` has `id`, `text`, `lang`. One aggregate gives each language's size and, from it, the share of hashes that holds
    twice the characters wanted; only those rows come to the driver. Of a text longer than `sample_chars` its first
    `sample_chars` characters may be drawn, so a language with long texts only is learned too.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)).withColumn("text", F.substring("text", 1, sample_chars))
    sizes = usable.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    shares = {r["lang"]: min(1.0, 2.0 * sample_chars / r["chars"] + 8.0 / r["n"]) for r in sizes.collect()}
    if not shares:
        return {}
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang")), F.lit(-1.0))
    rows = usable.withColumn("place", place).filter(F.col("place") < share).select("lang", "text", "place")
    drawn: dict[str, list[str]] = {language: [] for language in shares}
    for row in sorted(rows.collect(), key=lambda r: (r["lang"], r["place"], r["text"])):
        if sum(map(len, drawn[row["lang"]])) < sample_chars:
            drawn[row["lang"]].append(row["text"])
    return {language: texts for language, texts in drawn.items() if texts}


_MODELS: dict = {}


def identify(docs: DataFrame, samples: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `lang_pred`, `score` of every whole text; `und` and 0 where the text is null or has no letter."""
    import uuid

    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(Model(samples))  # languages x sample_chars bytes

    def run(batches):
        if name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = shared.value
        for batch in rows_of(batches, 512):
            found = _MODELS[name].predict(batch.column("text").to_pylist())
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double")


def learned_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held=None) -> DataFrame:
    """`id`, `text`, `lang` of the rows to learn from: those for which `held` is not true."""
    rows = docs if held is None else docs.filter(~held)
    return rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
