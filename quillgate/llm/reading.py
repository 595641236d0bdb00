"""Reading difficulty of documents on the scale of graded texts.

A regularised ordinal (proportional-odds) regression over features of the whole text: lexical
diversity, word rarity in the corpus, connectives, a proxy for clause depth, and lengths. It is fitted
to the readers' judgements; each judgement is an observation, so readers who disagree pull the
thresholds to where they disagree.

The proxy for clause depth counts, at each word of a sentence, the clauses open there: a subordinating
word and an opening bracket open one, a closing bracket closes one, and so does a comma unless a
subordinating word follows it.

A text is read once: what is written of it are the features that need no other text and the hashed
words, from which rarity follows when the whole corpus is counted. All features of a batch are computed
at once on arrays; what is known of a piece of text between two spaces is remembered by a task.

Only running words count. Layout, pasted identifiers, numbers and query text are set aside, and so are
names (words with a capital inside a sentence), which say nothing about how hard a text reads.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.workspace import materialize

BUCKET_BITS = 18
BANDS = 4
RIDGE = 0.3
#: Judgements the model is fitted to at most; which ones is decided by a hash of document and reader.
FIT_MOST = 20_000

# fixed values: common connectives and subordinating words of the four languages of the texts
CONNECTIVES = {
    "en": "although because if since therefore however while whereas unless until whether which that when where after before though thus hence moreover furthermore consequently nevertheless",
    "de": "obwohl weil wenn da daher jedoch während falls bis ob welche welcher welches dass nachdem bevor damit somit deshalb außerdem sodass dennoch",
    "fr": "bien parce si puisque donc cependant tandis lorsque quand jusque que qui dont afin ainsi toutefois pourtant car puis où",
    "es": "aunque porque si puesto pues embargo mientras cuando donde hasta que cual quien después antes así además luego cuyo",
}
# fixed values: words by which the language of a text is told
FUNCTION_WORDS = {
    "en": "the and of to is in for not it we you are was with by from on as an has",
    "de": "der die das und ist nicht ein eine mit von zu den dem im für wird auf sind hat",
    "fr": "le la les des une est pas dans et du pour avec a sur par sans il on au été",
    "es": "el la los las una es no en y del para con por se fue tiene está lo su al",
}
_CONNECTIVE = frozenset(w for ws in CONNECTIVES.values() for w in ws.split())
_FUNCTION = {k: frozenset(ws.split()) for k, ws in FUNCTION_WORDS.items()}

_QUERY_LINE = regex.compile(r"^\s*(?:--|(?i:select|with|insert|update|delete|create)\s)(?=.*[=();*'\"]).*$|^\s*(?i:from|where|group by|order by|and|having|limit)\b(?=.*[=();*'\"]).*$")
_QUERY_WORDS = frozenset("select with insert update delete create from where group order and having limit".split())
_NO_WORD = regex.compile(r"[_\\/@#=<>|{}\[\]0-9]|^[^.]*\p{L}\.\p{L}")
_ENDS = regex.compile(r"[.!?]+[\"'”»)]*$")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*")
_VOWELS = regex.compile(r"[aeiouyäöüéèêáíóúàùâîôûœ]+")

FEATURES = (
    "word_length", "long7", "long10", "long13", "syllables", "upper_quarter_length", "log_sentence", "log_sentence_weighted", "short_sentences",
    "repeat_rate", "window_diversity", "connectives", "clause_depth", "deepest_clause", "commas", "function_share", "log_words", "is_de", "is_fr", "is_es",
    "de_length", "fr_length", "es_length", "hard_sentences", "length_depth", "length_sentence", "hard_depth", "hard_sentence", "clauses", "length_clauses",
    "hard_clauses", "rarity", "rarity_upper",
)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & ((1 << BUCKET_BITS) - 1)


class _Words(dict):
    """Numbers words as they are met and keeps what is known of each."""

    def __init__(self) -> None:
        super().__init__()
        self.facts = [array("i") for _ in range(4 + len(_FUNCTION))]

    def __missing__(self, word: str) -> int:
        known = (len(word), len(_VOWELS.findall(word)), bucket(word), word in _CONNECTIVE, *(word in ws for ws in _FUNCTION.values()))
        for column, fact in zip(self.facts, known, strict=True):
            column.append(fact)
        self[word] = at = len(self)
        return at


class _Chunks(dict):
    """Numbers pieces of text between two spaces; number 0 stands for the border of a sentence."""

    def __init__(self) -> None:
        super().__init__()
        self.words = _Words()
        self.first, self.count, self.ends = array("q", [0]), array("i", [0]), array("b", [1])
        # by word of each chunk: number, capital, clauses opened before it, closed after it, a comma after it
        self.number, self.capital, self.opened, self.closed, self.comma = (array("i") for _ in range(5))
        self[None] = 0

    def __missing__(self, chunk: str) -> int:
        found = [] if _NO_WORD.search(chunk) else _WORD.findall(chunk)
        self.first.append(len(self.number))
        self.count.append(len(found))
        self.ends.append(bool(not _NO_WORD.search(chunk) and _ENDS.search(chunk)))
        for i, w in enumerate(found):
            last = i == len(found) - 1
            self.number.append(self.words[w.lower()])
            self.capital.append(w[0].isupper())
            self.opened.append(chunk.count("(") if i == 0 else 0)
            self.closed.append(chunk.count(")") if last else 0)
            self.comma.append(last and "," in chunk)
        self[chunk] = at = len(self)
        return at


_KNOWN = _Chunks()
#: Pieces that a task remembers before it begins anew.
MOST_KNOWN = 400_000
_UPPER = np.array([chr(i).isupper() for i in range(0x590)])
_LOWER = np.array([chr(i).islower() for i in range(0x590)])


def _chunks_of(text: str) -> list[int]:
    """The pieces of the running text in order, and 0 where a line ends a sentence."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[int] = []
    for line in text.split("\n"):
        parts = line.split()
        if not parts:
            out.append(0)
            continue
        head = parts[0]
        if (head[:2] == "--" or head.lower() in _QUERY_WORDS) and _QUERY_LINE.search(line):
            out.append(0)
            continue
        if head[0] in "-*•" or head[0].isupper():
            out.append(0)
        out += [_KNOWN[c] for c in parts]
    out.append(0)
    return out


def _shouts(text: str) -> bool:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes[codes < len(_UPPER)]
    return bool(np.count_nonzero(_UPPER[codes]) > 1.5 * np.count_nonzero(_LOWER[codes]))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0)


def _starts(groups: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.diff(groups, prepend=-1)) if len(groups) else np.zeros(0, np.int64)


def _upper(values: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """A quantile of each document's values, between neighbours in proportion."""
    ranked = values[np.lexsort((values, doc))]
    at = (n - 1) * share
    low = at.astype(np.int64)
    a, b = ranked[first + low], ranked[first + np.minimum(low + 1, n - 1)]
    return a + (b - a) * (at - low)


@dataclass(frozen=True)
class _Running:
    """The running words of some texts: word number, text, sentence (over all texts) and clauses open at each."""

    word: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    depth: np.ndarray


def _running(texts: list[str]) -> _Running:
    """Names (words with a capital inside a sentence) are left out, but where titles or whole texts have capitals."""
    global _KNOWN
    if len(_KNOWN) > MOST_KNOWN:
        _KNOWN = _Chunks()
    parts = [np.array(_chunks_of(t), np.int64) for t in texts]
    chunk = np.concatenate(parts)
    of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    count = np.array(_KNOWN.count)[chunk]
    border = np.cumsum(np.array(_KNOWN.ends)[chunk])
    # a chunk that ends a sentence belongs to it
    sentence_of = border - np.array(_KNOWN.ends)[chunk]
    total = int(count.sum())
    at = np.repeat(np.array(_KNOWN.first)[chunk] - (np.cumsum(count) - count), count) + np.arange(total)
    word, capital = np.array(_KNOWN.number)[at], np.array(_KNOWN.capital, bool)[at]
    doc, sentence = np.repeat(of, count), np.repeat(sentence_of, count)
    linked = np.array(_KNOWN.words.facts[3])[word] if total else np.zeros(0, int)
    first = _starts(sentence)
    size = np.diff(np.append(first, total))
    begins = np.zeros(total, bool)
    begins[first] = True
    closed, comma = np.array(_KNOWN.closed)[at], np.array(_KNOWN.comma)[at]
    step = (np.array(_KNOWN.opened)[at] + linked).astype(np.int64)
    step[1:] -= np.where(begins[1:], 0, closed[:-1] + np.where(linked[1:] > 0, 0, comma[:-1]))
    # clauses open: the running sum within the sentence, never below none
    run = np.cumsum(step)
    run -= np.repeat(run[first] - step[first], size)
    far = np.repeat(np.arange(len(first)), size) * (int(np.abs(step).sum()) + 1 if total else 1)
    depth = run - np.minimum(np.minimum.accumulate(run - far) + far, 0) if total else run
    titled = (size > 3) & (_sums(capital.astype(int), first) > 0.7 * size)
    loud = np.array([_shouts(t) for t in texts])
    keep = begins | ~capital | np.repeat(titled, size) | loud[doc]
    return _Running(word[keep], doc[keep], sentence[keep], depth[keep])


def sentences(text: str | None) -> list[list[str]]:
    """Running words of each sentence, in lower case."""
    if not text:
        return []
    found = _running([text])
    names = list(_KNOWN.words)
    firsts = _starts(found.sentence)
    return [[names[w] for w in part] for part in np.split(found.word, firsts[1:]) if len(part)]


def features(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """For each text the numbers of ``FEATURES`` but rarity (zeros), and the buckets of its words.

    A text without running words has no buckets.
    """
    x, buckets = np.zeros((len(texts), len(FEATURES))), [None] * len(texts)
    rows = [i for i, t in enumerate(texts) if t]
    part: list[int] = []
    room = 0
    for k, i in enumerate(rows):
        part.append(i)
        room += len(texts[i])
        if room > 4_000_000 or k == len(rows) - 1:
            _fill(x, buckets, [texts[j] for j in part], part)
            part, room = [], 0
    return x, buckets


def _fill(x: np.ndarray, buckets: list, texts: list[str], rows: list[int]) -> None:
    r = _running(texts)
    if not len(r.word):
        return
    facts = [np.array(c, float)[r.word] for c in _KNOWN.words.facts]
    length, vowels, hashed, linked = facts[0], facts[1], facts[2].astype(np.int32), facts[3]
    first = _starts(r.doc)
    docs = r.doc[first]
    n = np.diff(np.append(first, len(r.word)))

    def mean(values: np.ndarray) -> np.ndarray:
        return _sums(values, first) / n

    s_first = _starts(r.sentence)
    sizes = np.diff(np.append(s_first, len(r.word)))
    s_doc = np.searchsorted(docs, r.doc[s_first])
    d_first = _starts(s_doc)
    in_sentence = np.repeat(sizes, sizes).astype(float)
    # weighted by words: a short greeting before one endless sentence changes little
    hard_words = np.repeat(_sums(length, s_first) / sizes >= 8, sizes).astype(float)
    deepest = np.repeat(np.maximum.reduceat(r.depth, s_first), sizes).astype(float)
    where = np.repeat(np.arange(len(first)), n)
    _, times = np.unique(where.astype(np.int64) << 32 | r.word, return_counts=True)
    owner = np.repeat(np.arange(len(first)), _distinct(where, r.word, len(first)))
    simpson = np.bincount(owner, times * (times - 1.0), len(first)) / np.maximum(n * (n - 1.0), 1)
    # words that differ in every 40, the last ones left out if they are under 20
    spot = np.arange(len(r.word)) - np.repeat(first, n)
    window = spot // 40
    counted = (window == 0) | (window * 40 + 20 <= np.repeat(n, n))
    wide = where[counted].astype(np.int64) << 32 | window[counted]
    w_first = _starts(wide)
    w_size = np.diff(np.append(w_first, len(wide)))
    dense = np.repeat(np.arange(len(w_first)), w_size)
    diversity = _distinct(dense, r.word[counted], len(w_first)) / w_size
    w_doc = where[counted][w_first]
    by_lang = np.stack([mean(f) for f in facts[4:]], 1)
    lang = by_lang.argmax(1)
    word_length, depth, long, hard = mean(length), np.log1p(mean(r.depth.astype(float))), np.log(mean(in_sentence)), mean(hard_words)
    clauses = np.log1p(mean(np.repeat(_sums(linked, s_first), sizes)))
    commas = np.array([texts[d].count(",") for d in docs])
    columns = [
        word_length, mean(length >= 7), mean(length >= 10), mean(length >= 13), mean(vowels), _upper(length, r.doc, first, n, 0.75),
        np.log(n / np.diff(np.append(d_first, len(s_doc)))), long, mean(in_sentence <= 9),
        np.log(simpson + 1e-3), np.bincount(w_doc, diversity, len(first)) / np.bincount(w_doc, minlength=len(first)), mean(linked), depth, np.log1p(mean(deepest)),
        commas / n, by_lang.max(1), np.log(n), lang == 1, lang == 2, lang == 3,
        (lang == 1) * word_length, (lang == 2) * word_length, (lang == 3) * word_length, hard,
        # long words count for more where there are no clauses, and the reverse: lists of nouns and endless
        # sentences are hard in different ways
        word_length * depth, word_length * long, hard * depth, hard * long, clauses, word_length * clauses, hard * clauses,
    ]
    at = np.array(rows)[docs]
    for k, column in enumerate(columns):
        x[at, k] = column
    for i, words in zip(at.tolist(), np.split(hashed, first[1:]), strict=True):
        buckets[i] = words


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """How many different values each group has."""
    return np.bincount(np.unique(group.astype(np.int64) << 32 | value) >> 32, minlength=groups)


def document_frequencies(read: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold a word of each bucket, over all documents, and how many have words.

    ``2**BUCKET_BITS`` sums at most reach the driver, however large the corpus.
    """
    counts = read.filter("buckets is not null").select(F.explode(F.array_append(F.array_distinct("buckets"), F.lit(-1))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).toPandas()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    real = counts["slot"].to_numpy() >= 0
    out[counts["slot"].to_numpy()[real]] = counts["n"].to_numpy()[real]
    return out, int(counts["n"].to_numpy()[~real].sum())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, buckets = features(batch.column(1).to_pylist())
        none = np.array([b is None for b in buckets], bool)
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x.ravel(), np.full(len(x), len(FEATURES)), none), _lists(np.concatenate([b for b in buckets if b is not None] or [np.zeros(0, np.int32)]), np.array([0 if b is None else len(b) for b in buckets]), none, filled=False)], names=["doc_id", "x", "buckets"])


def _lists(flat: np.ndarray, sizes: np.ndarray, none: np.ndarray, *, filled: bool = True) -> pa.Array:
    """A list column; ``filled`` if the null rows have values too."""
    if filled:
        flat, sizes = flat[np.repeat(~none, sizes)], np.where(none, 0, sizes)
    ends = np.cumsum(sizes)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat), mask=pa.array(none))


def with_features(documents: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """``doc_id, x array<double>``; ``x`` is null for null and blank texts and those without words."""
    read = documents.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(_read, "doc_id bigint, x array<double>, buckets array<int>")
    read = materialize(read, "reading-words")
    counts, docs = document_frequencies(read)
    rarity = documents.sparkSession.sparkContext.broadcast(-np.log((counts + 1.0) / (docs + 1.0)).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = np.asarray(batch.column("x").is_valid())
            lists = batch.column("buckets").filter(pa.array(has))
            x = batch.column("x").filter(pa.array(has)).flatten().to_numpy().reshape(-1, len(FEATURES)).copy()
            if len(x):
                n = lists.value_lengths().to_numpy()
                rare, first = rarity.value[lists.flatten().to_numpy()].astype(float), np.cumsum(n) - n
                x[:, -2] = _sums(rare, first) / n
                x[:, -1] = _upper(rare, np.repeat(np.arange(len(n)), n), first, n, 0.8)
            full = np.zeros((len(has), len(FEATURES)))
            full[has] = x
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(full.ravel(), np.full(len(has), len(FEATURES)), ~has)], names=["doc_id", "x"])

    return read.mapInArrow(run, "doc_id bigint, x array<double>")


class OrdinalModel:
    """P(band > k) = sigmoid(w.z - t[k]) over standardised features z, thresholds t ascending."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.mean, self.scale, self.weights, self.thresholds = mean, scale, weights, thresholds

    @classmethod
    def fit(cls, x: np.ndarray, bands: np.ndarray, *, ridge: float = RIDGE, rounds: int = 40) -> OrdinalModel:
        """Penalised maximum likelihood by damped Newton steps."""
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = (x - mean) / scale
        p, k = z.shape[1], BANDS - 1
        shares = np.clip([(bands > b).mean() for b in range(1, BANDS)], 1e-3, 1 - 1e-3)
        theta = np.concatenate([np.zeros(p), -np.log(shares / (1 - shares))])
        over = (bands[:, None] > np.arange(1, BANDS)[None, :]).astype(float)

        # each threshold is a binary question; their sum is the composite likelihood of the ordered answer
        def parts(th: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            eta = (z @ th[:p])[:, None] - th[p:][None, :]
            prob = 1 / (1 + np.exp(-eta))
            loss = (np.logaddexp(0, eta) - over * eta).sum() + ridge / 2 * (th[:p] ** 2).sum()
            miss, curve = prob - over, prob * (1 - prob)
            grad = np.concatenate([z.T @ miss.sum(1) + ridge * th[:p], -miss.sum(0)])
            hess = np.zeros((p + k, p + k))
            hess[:p, :p] = (z * curve.sum(1)[:, None]).T @ z + ridge * np.eye(p)
            hess[:p, p:] = -z.T @ curve
            hess[p:, :p] = hess[:p, p:].T
            hess[p:, p:] = np.diag(curve.sum(0))
            return loss, grad, hess

        loss, grad, hess = parts(theta)
        for _ in range(rounds):
            step, pace = np.linalg.solve(hess + 1e-6 * np.eye(p + k), grad), 1.0
            while pace > 1e-4:
                new = parts(theta - pace * step)
                if new[0] <= loss:
                    break
                pace /= 2
            done = loss - new[0] < 1e-7 * abs(loss)
            theta, (loss, grad, hess) = theta - pace * step, new
            if done:
                break
        return cls(mean, scale, theta[:p], np.maximum.accumulate(theta[p:]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def band(self, x: np.ndarray) -> np.ndarray:
        return 1 + (self.score(x)[:, None] > self.thresholds[None, :]).sum(1)


def fit_readers(featured: DataFrame, judgements: DataFrame, *, most: int = FIT_MOST, ridge: float = RIDGE) -> OrdinalModel:
    """Fits to at most ``most`` judgements (``doc_id, reader, band``); null bands and unknown documents don't count."""
    usable = judgements.filter(F.col("band").between(1, BANDS)).select("doc_id", "reader", "band")
    chosen = usable.orderBy(F.xxhash64("doc_id", "reader"), "doc_id", "reader", "band").limit(most)
    rows = featured.filter("x is not null").join(chosen, "doc_id").select("x", "band").toPandas()
    if rows["band"].nunique() < 2:
        raise ValueError("judgements of at least two bands are needed")
    return OrdinalModel.fit(np.stack(rows["x"].to_numpy()), rows["band"].to_numpy(), ridge=ridge)


def reading_levels(featured: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, band int, level double`` for every row of ``featured``; a text without words has null for both.

    ``level`` runs on through the bands: a text at the border of bands 1 and 2 has 1.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column("x").to_pylist()
            has = np.array([v is not None for v in xs])
            band, level = np.zeros(len(xs), np.int32), np.zeros(len(xs))
            if has.any():
                x = np.array([v for v in xs if v is not None])
                s, t = model.score(x), model.thresholds
                band[has] = model.band(x)
                level[has] = np.interp(s, np.concatenate([[t[0] - 8], t, [t[-1] + 8]]), [0.5, *np.arange(1, BANDS) + 0.5, BANDS + 0.5])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(band, mask=~has), pa.array(level, mask=~has)], names=["doc_id", "band", "level"])

    return featured.mapInArrow(run, "doc_id bigint, band int, level double")
