"""The subjects of each document, by a guided latent Dirichlet topic model.

Labelled passages seed one topic per subject; further topics are free to take up everything else.
The model is fitted over the passages of all documents; a topic belongs to a subject only if its
top terms are terms of that subject. A document has the subjects that hold two sentences in a row
of one of its passages.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release

#: Terms are hashed into so many places, so the model's size doesn't grow with the corpus: at most
#: 2^19 rows of 40 topics in single precision, 84 MB, on the driver (four such arrays at a time), in
#: the broadcast of a round and in the sums of a task.
PLACES = 1 << 19
#: A phrase seen less often in the whole corpus is taken for one with a slip of the pen: it counts as
#: the oftener phrases in it. If there are none it stands for itself, so no phrase is dropped.
LEAST_SEEN = 3
#: Words of the longest phrase.
LONGEST = 4
FREE_TOPICS = 30
ROUNDS, INNER = 8, 6
ALPHA, ETA = 0.1, 0.01
#: Share of the seeds' weight against all words of the corpus, in every round.
SEED_WEIGHT = 0.05
#: Weights of the corpus' word shares at the start: of unlabelled phrases in a subject's topic (in a free
#: topic it is 1 with noise), of labelled ones in their subject's topic and elsewhere.
SUBJECT_START, SEED_HIGH, SEED_LOW = 0.7, 20.0, 0.05
#: A word in labelled passages of at least so many subjects belongs to none of them.
COMMON_IN = 4
#: Least probability of a sentence's subject.
SURE = 0.7
#: A topic is a subject's if at least so many of its top terms are known as the subject's, and these
#: weigh at least such shares of its known top terms and of all its top terms.
TOP_TERMS, LEAST_KNOWN, MAPPED, LEAST_WEIGHT = 30, 3, 0.8, 0.3
#: Else it is a subject's if it shares its passages with the subjects' topics, and of these mostly with one's.
COMPANY, ONE_COMPANY = 0.25, 0.8

_TOKEN = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
_CJK = re.compile(r"[\u3400-\u9fff]+")
_CODE = re.compile(r"^\s*(#\s*(include|define|if|ifdef|ifndef|endif|pragma)\b|import\b.*['\";]|export\s|static\s|const\s|package\s.*;|def\s.*:|class\s.*[:{]|return\b|from\s+\S+\s+import\b|import\s+\w+$|[\w.]+\s*=[^=]|```)|[;{}]\s*$")
#: Ends a line on purpose; room a line leaves at least if it ends so.
BREAK, SLACK = "\x1e", 15
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])|\x1e")
_HEX = re.compile(r"[0-9a-f]{12}")
_CHUNK = re.compile(r"[^\s\x1e\u3400-\u9fff。，]+")
_MARKS = re.compile(r"^(?:/\*+|\*+/|\*+(?=\s|$)|//+|#+(?=\s)|>+|[-•](?=\s)|\d+\.(?=\s))")


def _is_code(line: str) -> bool:
    return not line.endswith((".", "!", "?", "。")) and bool(_CODE.search(line))


def paragraphs(text: str) -> Iterator[str]:
    """Runs of lines without blank lines, code lines or the marks of comments, lists and quotes."""
    lines: list[str] = []
    for line in [*text.split("\n"), ""]:
        line = line.strip()
        stop = line.endswith("*/")
        if line:
            if _is_code(line):
                line, stop = "", True
            else:
                line = _MARKS.sub("", line, count=1)
                line = (line[:-1].rstrip("*") if stop and line else line).strip()
        if line:
            lines.append(line)
        if (not line or stop) and lines:
            yield _joined(lines)
            lines = []


def _joined(lines: list[str]) -> str:
    """The lines of a paragraph as one text, with a BREAK where a line ends before its time.

    Wrapped lines end because the next word doesn't fit; a line that leaves room for much more than
    that word, before a line that doesn't go on in lower case, was ended on purpose.
    """
    width = max(map(len, lines)) - SLACK
    out = [lines[0]]
    for before, line in zip(lines, lines[1:], strict=False):
        on_purpose = not line[0].islower() and len(before) + len(line.split(None, 1)[0]) < width
        out += [BREAK if on_purpose else "\n", line]
    return "".join(out)


def _without_addresses(text: str) -> str:
    """Addresses and long numbers end a sentence: they stand where labels stand, not within prose."""
    if "@" not in text and "://" not in text and not _HEX.search(text):
        return text
    return _CHUNK.sub(lambda m: ". " if "@" in m[0] or "://" in m[0] or _HEX.search(m[0]) else m[0], text)


@functools.lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def sentence_words(sentence: str) -> list[tuple[str, bool]]:
    """Words of a sentence in order, and whether each follows the one before directly.

    Chinese text is taken as pairs of characters; identifiers are left out.
    """
    plain = sentence.isascii()
    text = (sentence if plain else unicodedata.normalize("NFKC", sentence)).lower()
    out: list[tuple[str, bool]] = []
    end = -1
    for m in _TOKEN.finditer(text):
        word = m[0]
        if not plain and _CJK.search(word):
            for run in _CJK.findall(word):
                out += [(run[i : i + 2], False) for i in range(len(run) - 1)]
            end = -1
        else:
            gap = text[end : m.start()] if end >= 0 else "|"
            out.append((_stem(word), gap == " " or not gap.strip(" \t\n-")))
            end = m.end()
    return out


@functools.lru_cache(maxsize=200_000)
def place(term: str) -> int:
    return zlib.crc32(term.encode("utf-8")) % PLACES


def runs(sentence: str, common: frozenset[str]) -> list[str] | None:
    """The runs of words of a sentence that aren't common, with nothing but blanks or hyphens between; None if it has no words at all."""
    found = sentence_words(sentence)
    if not found:
        return None
    out: list[str] = []
    run: list[str] = []
    for word, joined in [*found, ("", False)]:
        if run and (not joined or word in common):
            out.append(" ".join(run))
            run = []
        if word and word not in common:
            run.append(word)
    return out


def phrases(run: str, known: np.ndarray | None = None) -> list[str]:
    """The phrases of a run: itself if it has up to LONGEST words, else its words.

    With ``known`` (by place) a run that isn't a known phrase, as a slip of the pen makes them, gives
    the longest known phrases in it; without any it is as if nothing were known.
    """
    words = run.split(" ")
    whole = [run] if len(words) <= LONGEST else words
    if known is None or (len(words) <= LONGEST and known[place(run)]):
        return whole
    return _known_within(words, known) or whole


def terms(sentence: str, common: frozenset[str], known: np.ndarray | None = None) -> list[str] | None:
    """The phrases of a sentence; None if it has no words at all."""
    found = runs(sentence, common)
    return None if found is None else [p for r in found for p in phrases(r, known)]


def _known_within(run: list[str], known: np.ndarray) -> list[str]:
    at, out = 0, []
    while at < len(run):
        for n in range(min(LONGEST, len(run) - at), 0, -1):
            if known[place(phrase := " ".join(run[at : at + n]))]:
                out.append(phrase)
                at += n
                break
        else:
            at += 1
    return out


def _json_texts(text: str) -> str:
    """The strings of a JSON text, each as a paragraph; any other text as it is."""
    try:
        stack, out = [json.loads(text)], []
    except (ValueError, RecursionError):
        return text.replace("\\n", "\n")
    while stack:
        value = stack.pop()
        if isinstance(value, str):
            out.append(value)
        elif isinstance(value, dict | list):
            stack += reversed(value.values() if isinstance(value, dict) else value)
    return "\n\n".join(out)


def split_passages(text: str | None, common: frozenset[str]) -> Iterator[list[list[str]]]:
    """The runs of each sentence of each paragraph that has words."""
    if not text or not text.strip():
        return
    if text.lstrip()[:1] == "{":
        text = _json_texts(text)
    for paragraph in paragraphs(text.replace("\r\n", "\n").replace("\r", "\n")):
        sentences = [t for s in _SENTENCE.split(_without_addresses(paragraph)) if (t := runs(s, common)) is not None]
        if sentences:
            yield sentences


@dataclass
class Seeds:
    """What the labelled passages tell: the subjects, common words, and terms counted by subject."""

    subjects: list[str]
    common: frozenset[str]
    counts: dict[str, Counter]

    @staticmethod
    def learn(examples: Iterable[tuple[str, str]]) -> Seeds:
        examples = [(t, s) for t, s in examples if t and s]
        where: dict[str, set[str]] = defaultdict(set)
        for text, subject in examples:
            for w, _ in sentence_words(text):
                where[w].add(subject)
        common = frozenset(w for w, s in where.items() if len(s) >= COMMON_IN)
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, subject in examples:
            for sentences in split_passages(text, common):
                for found in sentences:
                    counts[subject].update(p for r in found for p in phrases(r))
        return Seeds(sorted(counts), common, dict(counts))


def run_table(documents: DataFrame, key: str, text: str, seeds: Seeds) -> DataFrame:
    """``key, runs``: a row per paragraph, its sentences as arrays of runs of words. The one pass over the texts."""
    kind = documents.schema[key].dataType.simpleString()
    common = seeds.common

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, value in enumerate(b.column(1)):
                for sentences in split_passages(value.as_py(), common):
                    at.append(i)
                    found.append(sentences)
                    if len(at) >= 20_000:
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.list_(pa.list_(pa.string())))], ["key", "runs"])
                        at, found = [], []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.list_(pa.list_(pa.string())))], ["key", "runs"])

    return documents.select(key, text).mapInArrow(run, f"key {kind}, runs array<array<string>>")


def known_phrases(table: DataFrame, seeds: Seeds) -> tuple[np.ndarray, np.ndarray]:
    """Which places hold a known phrase, and the row in the model of each place (-1 if it is empty).

    Known are phrases that all documents together have at least LEAST_SEEN times, and those of
    labelled passages. A place has a row if a run, a word of it or a labelled phrase falls there.
    Counted on the cluster; at most PLACES numbers come to the driver.
    """
    at = lambda c: F.pmod(F.crc32(c), F.lit(PLACES)).cast("int")
    words = F.split("run", " ")
    # a short run counts as itself; words too get a row, as they may stand for an unknown run, but count only in long runs
    long = F.size(words) > LONGEST
    shown = F.concat(F.when(long, F.array().cast("array<struct<place:int,n:int>>")).otherwise(F.array(F.struct(at("run").alias("place"), F.lit(1).alias("n")))), F.when(long, F.transform(words, lambda w: F.struct(at(w).alias("place"), F.lit(1).alias("n")))).otherwise(F.array().cast("array<struct<place:int,n:int>>")))
    counted = table.select(F.explode(F.flatten("runs")).alias("run")).select(F.explode(shown).alias("x")).groupBy("x.place").agg(F.sum("x.n").alias("n")).toArrow()
    places, n = counted.column("place").to_numpy(), counted.column("n").to_numpy()
    labelled = np.array([place(t) for c in seeds.counts.values() for t in c], int)
    known = np.zeros(PLACES, bool)
    known[places[n >= LEAST_SEEN]] = True
    known[labelled] = True
    rows = np.full(PLACES, -1, np.int32)
    used = np.union1d(places, labelled).astype(int)
    rows[used] = np.arange(len(used))
    return known, rows


def passage_table(table: DataFrame, known: np.ndarray, rows: np.ndarray) -> DataFrame:
    """``key, sentences``: a row per paragraph, its sentences as arrays of the rows of their phrases."""
    kind = table.schema["key"].dataType.simpleString()
    sent = table.sparkSession.sparkContext.broadcast((np.packbits(known), rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, rows = sent.value
        known = np.unpackbits(packed, count=PLACES).astype(bool)
        held: dict[str, list[int]] = {}
        for b in batches:
            outer, inner = b.column(1).offsets.to_numpy(), b.column(1).flatten()
            ends, flat = inner.offsets.to_numpy(), inner.flatten().to_pylist()
            if len(held) > 500_000:
                held.clear()
            found = []
            for r in flat:
                got = held.get(r)
                if got is None:
                    got = held[r] = [int(rows[p]) for t in phrases(r, known) if rows[p := place(t)] >= 0]
                found.append(got)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            before = np.r_[0, np.cumsum(sizes)]
            ids = pa.array(np.fromiter((i for f in found for i in f), np.int32, int(before[-1])))
            sentences = pa.ListArray.from_arrays(pa.array(before[ends - ends[0]].astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array((outer - outer[0]).astype(np.int32)), sentences)], ["key", "sentences"])

    return table.select("key", "runs").mapInArrow(run, f"key {kind}, sentences array<array<int>>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of a batch, and for each the number of its sentence and of its paragraph."""
    outer = column.offsets.to_numpy() - column.offsets[0].as_py()
    inner = column.flatten()
    ends = inner.offsets.to_numpy() - inner.offsets[0].as_py()
    ids = inner.flatten().to_numpy(zero_copy_only=False)
    sentence = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    paragraph_of = np.repeat(np.arange(len(outer) - 1), np.diff(outer))
    return ids, sentence, paragraph_of


def _exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp of the digamma function, by its series above six."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(6):
        shift += 1 / y
        y += 1
    z = 1 / (y * y)
    return np.exp(np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - shift)


def infer(ids: np.ndarray, owner: np.ndarray, owners: int, phi: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """Topic shares of each owner (a passage), and of each term within it; ``phi`` is places x topics."""
    rows = phi[ids]
    gamma = np.full((owners, phi.shape[1]), ALPHA + 1.0, np.float32)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, int)
    share = rows
    for _ in range(inner):
        share = rows * _exp_digamma(gamma)[owner]
        share /= share.sum(1, keepdims=True) + 1e-30
        gamma[:] = ALPHA
        if len(owner):
            gamma[owner[starts]] += np.add.reduceat(share, starts, axis=0)
    return gamma, share


def _totals(table: DataFrame, height: int, width: int, per_batch) -> np.ndarray:
    """A matrix of sums over the whole table: each task adds up its own and hands over the rows it used."""
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width), np.float32)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                per_batch(b.slice(at, 2000).column(0), total)
        used = np.flatnonzero(total.any(1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, i].astype(np.float64)) for i in range(width))], ["at", *names])

    sums = table.select("sentences").mapInArrow(run, "at int, " + ", ".join(f"{n} double" for n in names)).groupBy("at").agg(*[F.sum(n).cast("float").alias(n) for n in names])
    got = sums.toArrow()
    out = np.zeros((height, width), np.float32)
    if got.num_rows:
        out[got.column("at").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], axis=1)
    return out


@dataclass
class SubjectModel:
    seeds: Seeds
    rows: np.ndarray
    phi: np.ndarray
    subject_of: list[str | None]


def fit(passages: DataFrame, seeds: Seeds, rows: np.ndarray, rounds: int = ROUNDS, free: int = FREE_TOPICS, seed: int = 11) -> SubjectModel:
    """Variational Bayes over all passages; a round is one distributed pass.

    Topics start from the corpus' word shares, labelled phrases in their subjects' topics. After each
    round a topic's word weights are what the passages gave it, plus the seeds (weighted by the
    size of the corpus) and a small constant.
    """
    context = passages.sparkSession.sparkContext
    topics = len(seeds.subjects) + free

    def count(column, total):
        np.add.at(total[:, 0], _flat(column)[0], 1)

    size = int(rows.max()) + 1
    seen = _totals(passages, size, 1, count)[:, 0]
    rng = np.random.default_rng(seed)
    sown = np.zeros((size, topics), np.float32)
    for k, subject in enumerate(seeds.subjects):
        for term, n in seeds.counts[subject].items():
            sown[rows[place(term)], k] += n
    base = ((seen + 0.1) / (seen + 0.1).sum(dtype=np.float64)).astype(np.float32)
    labelled = sown.sum(1, keepdims=True) > 0
    # free topics start from noisy word shares, the subjects' from even ones; a labelled phrase starts
    # high where it is labelled and low everywhere else, however frequent it is
    start = np.where(sown.sum(0) > 0, SUBJECT_START, rng.gamma(100, 0.01, (size, topics)).astype(np.float32))
    start = np.where(labelled, SEED_HIGH * sown / np.maximum(sown.sum(1, keepdims=True), 1) + SEED_LOW, start)
    phi = base[:, None] * start
    anchor = sown / np.maximum(sown.sum(0), 1) * np.float32(SEED_WEIGHT * seen.sum(dtype=np.float64) / topics)
    for _ in range(rounds):
        sent = context.broadcast(phi.astype(np.float32))

        def gather(column, total, sent=sent):
            ids, sentence, of = _flat(column)
            _, share = infer(ids, of[sentence], len(column), sent.value)
            order = np.argsort(ids, kind="stable")
            firsts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0]) if len(ids) else np.zeros(0, int)
            if len(ids):
                total[ids[order][firsts]] += np.add.reduceat(share[order], firsts, axis=0)

        phi = _totals(passages, size, topics, gather)
        phi += anchor
        phi += ETA
        phi /= phi.sum(0, dtype=np.float64)
        sent.destroy()
    model = SubjectModel(seeds, rows, phi.astype(np.float32), [])
    model.subject_of = [subject for subject, _ in map_topics(model)]
    sent = context.broadcast(model.phi)

    def meet(column, total):
        ids, sentence, of = _flat(column)
        gamma, _ = infer(ids, of[sentence], len(column), sent.value)
        words = gamma - ALPHA
        total += words.T @ (words / np.maximum(words.sum(1, keepdims=True), 1e-9))

    join_company(model, _totals(passages, topics, topics, meet))
    sent.destroy()
    return model


def join_company(model: SubjectModel, meetings: np.ndarray) -> None:
    """Give topics that no known term speaks for to the subject in whose passages they stand.

    ``meetings[j, k]``: how much of topic j stands in passages of topic k. A subject's terms that
    no labelled passage shows may fall into a topic of their own, but they share their passages
    with the subject's other terms; set phrases share theirs with all subjects.
    """
    first = list(model.subject_of)
    for j, subject in enumerate(first):
        if subject is None:
            company = {s: sum(meetings[j, k] for k, t in enumerate(first) if t == s) for s in model.seeds.subjects}
            best = max(company, key=lambda s: company[s])
            total = sum(company.values())
            if total >= COMPANY * meetings[j].sum() > 0 and company[best] >= ONE_COMPANY * total:
                model.subject_of[j] = best


def map_topics(model: SubjectModel) -> list[tuple[str | None, list[int]]]:
    """For each topic its subject, if its top terms are that subject's, and the rows of the top terms.

    A top term speaks for the subject in whose labelled passages it is most at home; terms of no
    labelled passage don't vote.
    """
    seeds, homes = model.seeds, {}
    shares = {s: {int(model.rows[place(t)]): n / sum(c.values()) for t, n in c.items()} for s, c in seeds.counts.items()}
    for p in {p for c in shares.values() for p in c}:
        homes[p] = max(seeds.subjects, key=lambda s: shares[s].get(p, 0))
    out = []
    for k in range(model.phi.shape[1]):
        top = np.argsort(-model.phi[:, k], kind="stable")[:TOP_TERMS]
        weight: dict[str, float] = defaultdict(float)
        for p in top.tolist():
            if p in homes:
                weight[homes[p]] += float(model.phi[p, k])
        best = max(weight, key=lambda s: weight[s], default=None)
        known = sum(homes.get(p) == best for p in top.tolist())
        sure = best is not None and known >= LEAST_KNOWN and weight[best] >= max(MAPPED * sum(weight.values()), LEAST_WEIGHT * float(model.phi[top, k].sum()))
        out.append((best if sure else None, top.tolist()))
    return out


def sentence_subjects(column: pa.ListArray, model: SubjectModel) -> tuple[np.ndarray, np.ndarray]:
    """For each sentence of a batch of passages its subject's number (or -1), and its passage's number.

    A sentence's topic weighs the passage's topic shares by the likelihood of the sentence's own terms.
    """
    ids, sentence, of = _flat(column)
    phi = model.phi
    number = np.array([model.seeds.subjects.index(s) if s else -1 for s in model.subject_of])
    if not len(of):
        return np.zeros(0, int), of
    owner = of[sentence]
    gamma, _ = infer(ids, owner, len(column), phi)
    theta = gamma / gamma.sum(1, keepdims=True)
    floor = 1e-6
    score = np.log(theta[of] + 1e-3)
    np.add.at(score, sentence, np.log(phi[ids] + floor))
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    p /= p.sum(1, keepdims=True)
    by_subject = np.zeros((len(of), len(model.seeds.subjects)))
    for k, s in enumerate(number):
        if s >= 0:
            by_subject[:, s] += p[:, k]
    best = by_subject.argmax(1)
    has = np.zeros(len(of), bool)
    has[sentence] = True
    return np.where(has & (by_subject.max(1) >= SURE), best, -1), of


def passage_runs(subject: np.ndarray, of: np.ndarray) -> set[tuple[int, int]]:
    """(passage, subject) of two sentences in a row."""
    same = (subject[1:] == subject[:-1]) & (of[1:] == of[:-1]) & (subject[1:] >= 0)
    return set(zip(of[1:][same].tolist(), subject[1:][same].tolist(), strict=True))


def assign(passages: DataFrame, model: SubjectModel, key: str) -> DataFrame:
    """``key, subject``: the subjects of each document, without repeats."""
    kind = passages.schema["key"].dataType.simpleString()
    # the workers need no places any more
    sent = passages.sparkSession.sparkContext.broadcast(SubjectModel(model.seeds, np.zeros(0, np.int32), model.phi, model.subject_of))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                runs = sorted(passage_runs(*sentence_subjects(part.column(1), model)))
                rows = part.column(0).take(pa.array([i for i, _ in runs], pa.int32()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([model.seeds.subjects[s] for _, s in runs], pa.string())], ["key", "subject"])

    return passages.select("key", "sentences").mapInArrow(run, f"key {kind}, subject string").distinct().withColumnRenamed("key", key)


def read_seeds(examples: DataFrame) -> Seeds:
    """Seeds of a table of labelled passages of fixed size (read by the driver)."""
    return Seeds.learn((r.text, r.subject) for r in examples.select("text", "subject").distinct().orderBy("subject", "text").collect())


def find_subjects(documents: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, subject`` of each document with a passage of two sentences or more on the subject.

    Null, empty and blank texts have no subject. A document may have several. Repeated rows give
    no repeats. Whole texts are read, cut into paragraphs (comment, list and quote marks dropped,
    code lines apart) and sentences; the model is fitted over the passages of all documents.
    Without documents or examples the result is empty.
    """
    seeds = read_seeds(examples)
    if not seeds.subjects:
        return documents.select(F.col(key), F.lit(None).cast("string").alias("subject")).limit(0)
    read = cut(run_table(documents, key, text, seeds))
    known, rows = known_phrases(read, seeds)
    passages = cut(passage_table(read, known, rows))
    release(read)
    return assign(passages, fit(passages, seeds, rows), key)


def makeup(found: DataFrame, documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """``subject, documents, share`` of each listed subject, and of documents without any (``none``).

    ``share`` is of all documents; as a document may have several subjects the shares may add up to
    more than one.
    """
    per = found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    every = documents.agg(F.count(F.lit(1)).alias("n"))
    some = found.agg(F.countDistinct(found.columns[0]).alias("k"))
    listed = subjects.select("subject").filter(F.col("subject").isNotNull()).distinct().join(per, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"))
    none = every.crossJoin(some).select(F.lit("none").alias("subject"), (F.col("n") - F.col("k")).alias("documents"))
    # one row of totals: the cross join adds no rows
    return listed.unionByName(none).crossJoin(every).select("subject", "documents", F.round(F.col("documents") / F.greatest("n", F.lit(1)), 6).alias("share"))
