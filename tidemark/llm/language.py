"""Language of each document and segment (problem 7): words first, then shorter and shorter n-grams.

The counts come from a bounded sample of labelled documents: first under their labels, which are noisy,
then again under the languages that the first model gives each sentence. A known word scores its log frequency
in each language; an unseen one falls back to its character n-grams, at each place the longest that the
model knows, down to single characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

# Codes and names by which a label states a language.
LABELS = {
    "en": ["en", "eng", "english", "anglais", "englisch", "inglés", "ingles", "inglês", "engels"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "franzoesisch", "francés", "frances", "francês", "frans"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "alemão", "alemao", "duits"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "espagnol", "spanisch", "espanhol", "spaans"],
    "pt": ["pt", "por", "portuguese", "português", "portugues", "portugais", "portugiesisch", "portugués", "portugees"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish", "vlaams", "néerlandais", "niederländisch", "neerlandés", "holandés", "holandês", "neerlandês"],
}

# The words of filler Latin.
FILLER = set(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa "
    "qui officia deserunt mollit anim id est laborum".split()
)

WORD = re.compile(r"[^\W\d_]+")
_FIELD = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|<<.*?>>|[$#]\{.*?\}|\*\|.*?\|\*|@@\w+@@|__\w+__|%[A-Z_]+%|\[\[.*?\]\]|\{[\w. ]+\}|`[^`]*`|https?://\S+|<[^<>]*>")
#: Every part of _FIELD begins with or holds one of these.
_MARK = re.compile(r"[{%<$#*@`\[]|__|://")
_END = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+")
_CODE = re.compile(r"[{}<>=;_|\\/]")
MAX_N = 3


def label_language(label: Column) -> Column:
    """The language code that a label states, in any spelling and with any region; null if none."""
    plain = F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " ")))
    first = F.regexp_extract(plain, r"^([^-_ (,;.]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in LABELS.items():
        out = F.when(first.isin(names), F.lit(code)).otherwise(out)
    return out


def sentences(text: str | None) -> list[tuple[int, str, bool]]:
    """(paragraph number, sentence, whether it is whole): fields, code and addresses are taken out."""
    out: list[tuple[int, str, bool]] = []
    if not text:
        return out
    for number, line in enumerate(re.split(r"\r\n?|\n", text)):
        line = (_FIELD.sub(" ", line) if _MARK.search(line) else line).strip()
        if not line:
            continue
        for piece in _END.split(line):
            piece = piece.strip()
            if piece:
                whole = piece.rstrip("\"'”»)]")[-1:] in (".", "!", "?", "…") and len(WORD.findall(piece)) >= 4
                out.append((number, piece, whole))
    return out


class LanguageModel:
    """Word and n-gram log frequencies of the languages that have counts; ``score`` adds them up for a text."""

    def __init__(self, counts: dict[str, dict[str, float]], languages: list[str]):
        languages = [x for x in languages if counts.get(x)]
        self.languages = languages
        n = len(languages)
        distinct = len(set().union(*(counts[x] for x in languages))) if languages else 0
        total = np.array([sum(counts[x].values()) for x in languages], float) + 0.05 * distinct
        self.words: dict[str, int] = {}
        scores: list[np.ndarray] = []
        table: dict[str, np.ndarray] = {}
        for k, code in enumerate(languages):
            for word, c in counts[code].items():
                table.setdefault(word, np.zeros(n))[k] += c
        self.grams: list[dict[str, np.ndarray]] = [defaultdict(lambda: np.zeros(n)) for _ in range(MAX_N + 1)]
        for word, c in table.items():
            self.words[word] = len(self.words)
            scores.append(np.log((c + 0.05) / total))
            share = c / total * total.max()
            padded = f" {word} "
            for size in range(1, MAX_N + 1):
                for i in range(len(padded) - size + 1):
                    self.grams[size][padded[i : i + size]] += share
        self.gram_score = []
        for size in range(MAX_N + 1):
            sums = sum(self.grams[size].values(), np.zeros(n)) + 1
            self.gram_score.append({g: np.log((c + 0.5) / sums) for g, c in self.grams[size].items()})
        self.grams = []
        # The last row, at -1, stands for unseen words and adds nothing.
        self.scores = np.array([*scores, np.zeros(n)])
        self.memory: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            padded = f" {word} "
            hits = []
            for i in range(len(padded)):
                for size in range(min(MAX_N, len(padded) - i), 0, -1):
                    score = self.gram_score[size].get(padded[i : i + size])
                    if score is not None:
                        hits.append(score)
                        break
            found = np.mean(hits, axis=0) if hits else np.zeros(len(self.languages))
            # An unseen word is often a name, which tells little: it counts half.
            found = 0.5 * (found - found.max())
            self.memory[word] = found
        return found

    def score_all(self, texts: list[str]) -> list[tuple[str | None, float, float]]:
        """(language, confidence, share of filler words) of each text; the language is null where no word is known."""
        split = [WORD.findall(text.lower()) for text in texts]
        at = [k for k, words in enumerate(split) if words]
        out: list[tuple[str | None, float, float]] = [(None, 0.0, 0.0)] * len(texts)
        if not at or not self.languages:
            return out
        starts, rows = [], []
        row = self.words.get
        for k in at:
            starts.append(len(rows))
            rows += [row(w, -1) for w in split[k]]
        total = np.add.reduceat(self.scores[rows], starts, axis=0)
        if -1 in rows:
            for i, k in enumerate(at):
                for word in split[k]:
                    if word not in self.words:
                        total[i] += self.unseen(word)
        sizes = np.array([len(split[k]) for k in at], float)
        p = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(sizes)[:, None])
        best, sure = total.argmax(axis=1), p.max(axis=1) / p.sum(axis=1)
        flat = np.ptp(total, axis=1) == 0
        for i, k in enumerate(at):
            filler = sum(map(FILLER.__contains__, split[k])) / len(split[k])
            out[k] = (None, 0.0, filler) if flat[i] and len(self.languages) > 1 else (self.languages[best[i]], float(sure[i]), filler)
        return out

    def score(self, text: str) -> tuple[str | None, float, float]:
        return self.score_all([text])[0]


class LanguageLabeller:
    """Gives documents and segments a language with a confidence.

    Parameters: ``sample``, the labelled rows of each language that the model is fitted on, chosen by the
    hash of their number (all rows where there are fewer; it bounds what is sent to the driver and
    broadcast: the words of 30,000 texts are under 100 MB on a worker); ``least`` confidence of a sentence.

    Defined results: null and empty texts have no segment; a document with no sentence of a known
    language gets a null language; filler Latin, unfilled fields, code and addresses are no language;
    a language without any labelled document can't be found; repeated rows give repeated results;
    other columns are not read.
    """

    def __init__(self, sample: int = 2_500, least: float = 0.8, row: str = "fetch_no", text: str = "body", label: str = "lang"):
        self.sample, self.least, self.row, self.text, self.label = sample, least, row, text, label

    def _counts(self, words: DataFrame) -> dict[str, dict[str, float]]:
        """The words of each language in the sample, which bounds them."""
        out: dict[str, dict[str, float]] = {code: {} for code in LABELS}
        for code, word, n in words.groupBy("code", "word").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
            out[code][word] = float(n)
        return out

    def fit(self, docs: DataFrame) -> LanguageModel:
        """The model of the sample's words: by label, then by the sentences' own languages."""
        labelled = docs.select(F.col(self.row).alias("row"), F.col(self.text).alias("text"), label_language(F.col(self.label)).alias("code")).where("text is not null and code is not null")
        sizes = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}  # one row a language
        part = F.lit(0.0)
        for code, n in sizes.items():
            part = F.when(F.col("code") == code, F.lit(min(1.0, self.sample / n))).otherwise(part)
        rows = materialize(labelled.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < part * (1 << 30)).select("code", "text"), "sample")
        first = LanguageModel(self._counts(rows.mapInPandas(_count_labelled, "code string, word string, n double")), list(LABELS))
        shared, least = docs.sparkSession.sparkContext.broadcast(first), self.least

        def recount(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for batch in batches:
                total: dict[str, Counter] = defaultdict(Counter)
                for text in batch["text"]:
                    own: dict[str, Counter] = defaultdict(Counter)
                    whole = [sentence for _, sentence, good in sentences(text) if good]
                    for sentence, (code, sure, filler) in zip(whole, model.score_all(whole)):
                        if code and sure >= least and filler < 0.5:
                            own[code].update(WORD.findall(sentence.lower()))
                    for code, counted in own.items():
                        _add(total[code], counted)
                yield _frame(total)

        return LanguageModel(self._counts(rows.select("text").mapInPandas(recount, "code string, word string, n double")), list(LABELS))

    def segments(self, docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
        """(row, segment, first, last, lang, confidence, sentences): runs of whole sentences of one language.

        ``first`` and ``last`` are lines of the text; ``confidence`` is the mean over the sentences.
        """
        model = model or self.fit(docs)
        shared, least = docs.sparkSession.sparkContext.broadcast(model), self.least

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared.value
            for batch in batches:
                out = []
                for row, text in zip(batch["row"], batch["text"]):
                    out += [(row, k, *segment) for k, segment in enumerate(segment_text(known, text, least))]
                yield pd.DataFrame(out, columns=["row", "segment", "first", "last", "lang", "confidence", "sentences"])

        rows = docs.select(F.col(self.row).alias("row"), F.col(self.text).alias("text")).where("row is not null and text is not null")
        return (rows.mapInPandas(cut, "row long, segment int, first int, last int, lang string, confidence double, sentences int")
                .withColumnRenamed("row", self.row))

    def labels(self, docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
        """(row, lang, confidence): the language with the most sentences of each document.

        ``confidence`` is that of its sentences times their share of all sentences; documents without
        a sentence of a known language have a null language and confidence 0.
        """
        each = self.segments(docs, model).groupBy(self.row, "lang").agg(F.sum("sentences").alias("n"), F.sum(F.col("sentences") * F.col("confidence")).alias("sure"))
        best = each.groupBy(self.row).agg(F.max_by("lang", F.struct("n", "sure", "lang")).alias("lang"), (F.max_by("sure", F.struct("n", "sure", "lang")) / F.sum("n")).alias("confidence"))
        return (docs.select(self.row).where(F.col(self.row).isNotNull()).distinct().join(best, self.row, "left")
                .withColumn("confidence", F.coalesce("confidence", F.lit(0.0))))

    def missing(self, docs: DataFrame, least_sentences: int = 2) -> DataFrame:
        """(row, lang): languages with ``least_sentences`` whole sentences in a row that the label doesn't state."""
        found = self.segments(docs).where(F.col("sentences") >= least_sentences).select(self.row, "lang").distinct()
        stated = docs.select(self.row, label_language(F.col(self.label)).alias("stated"))
        return (found.join(stated, self.row).where(F.col("stated").isNull() | (F.col("stated") != F.col("lang")))
                .select(self.row, "lang").distinct())


def segment_text(model: LanguageModel, text: str | None, least: float) -> list[tuple[int, int, str, float, int]]:
    """(first line, last line, language, confidence, whole sentences) of each run of one language."""
    out: list[tuple[int, int, str, float, int]] = []
    now: list | None = None
    pieces = sentences(text)
    scores = iter(model.score_all([sentence for _, sentence, whole in pieces if whole]))
    for line, sentence, whole in pieces:
        if not whole:
            now = None  # a heading or a fragment: the next sentence isn't in a row with the last
            continue
        code, sure, filler = next(scores)
        if not code or sure < least or filler >= 0.5 or len(_CODE.findall(sentence)) > 0.08 * len(sentence):
            now = None
            continue
        if now and now[2] == code:
            now[1], now[3], now[4] = line, now[3] + sure, now[4] + 1
        else:
            now = [line, line, code, sure, 1]
            out.append(now)  # type: ignore[arg-type]
    return [(a, b, code, sure / n, n) for a, b, code, sure, n in out]


def _add(total: Counter, own: Counter) -> None:
    """A document's counts grow by their logarithm: one long text with a wrong label can't outweigh the rest."""
    for word, n in own.items():
        total[word] += 1 + math.log(n)


def _frame(total: dict[str, Counter]) -> pd.DataFrame:
    rows = [(code, word, n) for code, words in total.items() for word, n in words.items()]
    return pd.DataFrame(rows, columns=["code", "word", "n"])


def _count_labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        total: dict[str, Counter] = defaultdict(Counter)
        for code, text in zip(batch["code"], batch["text"]):
            own: Counter = Counter()
            for _, sentence, whole in sentences(text):
                if whole:
                    own.update(WORD.findall(sentence.lower()))
            _add(total[code], own)
        yield _frame(total)
