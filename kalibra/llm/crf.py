"""Language of each word, and so of each text, by a linear-chain conditional random field (operator 3).

A word's features are its affixes, its character n-grams and whether it stands in the lexicon (the words
seen often in training); a label scores the sum of its features' weights, and neighbouring labels score
learned transitions. Forward-backward gives each word's label probabilities in context, so words of another
language inside a text are told apart; a text's language is the one of most expected words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import first_by_hash
from .shingles import mix

#: Rows of the table of hashed feature weights.
TABLE = 1 << 16
#: Words that forward-backward takes in one step's stride; longer texts are cut there and their parts joined exactly.
SEGMENT = 64
#: Edges of words: marks and digits, which say nothing about a language.
_EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha()) + "«»„“”‘’¡¿…–—·"


def words_of(text: str) -> list[str]:
    """The text's words, lower-cased, without marks at their ends; words without a letter are left out."""
    out = [w.strip(_EDGES) for w in text.lower().split()]
    return [w for w in out if w and (w.isalpha() or any(map(str.isalpha, w)))]


def slots_of(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of every feature of the words, all at once: n-grams of two and three characters within the word's
    bounds, affixes of one to three, each hashed into TABLE rows; a word of the lexicon has a row of its own behind them."""
    point = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], int)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = size[owner] - (np.arange(len(point)) - start[owner])
    slots, owners = [], []

    def add(kind: int, at: np.ndarray, k: int, own: np.ndarray) -> None:
        h = np.full(len(at), kind, np.uint64)
        for d in range(k):
            h = mix(h ^ point[at + d])
        slots.append((h >> np.uint64(32)).astype(np.int64) % TABLE)
        owners.append(own)

    for k in (2, 3):
        at = np.flatnonzero(left >= k)
        add(k, at, k, owner[at])
    for k in (1, 2, 3):
        long = np.flatnonzero(size - 2 >= k)
        add(10 + k, start[long] + 1, k, long)
        add(20 + k, start[long] + size[long] - 1 - k, k, long)
    entry = np.array([lexicon.get(w, -1) for w in words], int)
    slots.append(TABLE + entry[entry >= 0])
    owners.append(np.flatnonzero(entry >= 0))
    return np.concatenate(slots), np.concatenate(owners)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word of many texts, and expected transitions of all.

    scores: (words, labels), texts one after the other; trans[i, j] and start in logarithms. Each text is cut
    into segments of SEGMENT words. The product of a segment's matrices, which maps what comes before it to
    what comes after, is made for all segments side by side; texts are then walked by segments, and at last all
    segments by words, again side by side. All is scaled at every step, so long texts neither vanish nor overflow.
    """
    total, k = scores.shape
    probs, move = np.zeros((total, k)), np.exp(trans)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    begin = np.cumsum(lengths) - lengths
    segs = [(t, s, min(SEGMENT, n - (s - b))) for t, (b, n) in enumerate(zip(begin.tolist(), lengths.tolist(), strict=True)) for s in range(b, b + n, SEGMENT)]
    if not segs:
        return probs, np.zeros((k, k))
    text, first, size = (np.array(x) for x in zip(*segs, strict=True))
    order = np.argsort(-size, kind="stable")
    active = [int((size > j).sum()) for j in range(int(size.max()))]
    at0 = first[order]
    scaled = lambda x: x / x.sum(axis=-1, keepdims=True)
    # a segment's matrix: from the label before it to the label of its last word
    whole = np.broadcast_to(np.eye(k), (len(segs), k, k)).copy()
    is_first = np.concatenate([[True], text[1:] != text[:-1]])
    opens = is_first[order]
    emit[begin] *= np.exp(start)
    for j, n in enumerate(active):
        # nothing stands before a text's first word: any label may, alike
        x = whole[:n] @ (move if j else np.where(opens[:, None, None], 1.0, move)) * emit[at0[:n] + j][:, None, :]
        whole[:n] = x / x.sum(axis=(1, 2), keepdims=True)
    place = np.empty(len(segs), int)
    place[order] = np.arange(len(segs))
    ahead, behind = np.zeros((len(segs), k)), np.ones((len(segs), k))
    level = np.arange(len(segs)) - np.maximum.accumulate(np.where(is_first, np.arange(len(segs)), 0))
    levels = np.split(np.argsort(level, kind="stable"), np.cumsum(np.bincount(level))[:-1])
    for d, own in enumerate(levels):
        ahead[own] = 1 / k if d == 0 else scaled(np.einsum("ni,nij->nj", ahead[own - 1], whole[place[own - 1]]))
    for own in reversed(levels[1:]):
        behind[own - 1] = scaled(np.einsum("nij,nj->ni", whole[place[own]], behind[own]))
    # within segments, side by side
    fore = np.zeros((total, k))
    state = ahead[order]
    for j, n in enumerate(active):
        into = state[:n] @ move
        if not j:
            into[opens] = 1
        state[:n] = scaled(into * emit[at0[:n] + j])
        fore[at0[:n] + j] = state[:n]
    expected, back = np.zeros((k, k)), behind[order]
    for j in range(len(active) - 1, -1, -1):
        n = active[j]
        here = at0[:n] + j
        probs[here] = scaled(fore[here] * back[:n])
        right = emit[here] * back[:n]
        if j or len(segs) > len(lengths):
            left = fore[here - 1]
            inner = np.ones(n, bool) if j else ~opens
            pair = left[inner][:, :, None] * move * right[inner][:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[:n] = scaled(right @ move.T)
    return probs, expected


class Field:
    """Weights of a fitted field."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: dict[str, int], trans: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.lexicon, self.trans, self.start = labels, weights, lexicon, trans, start
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.labels)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def scores(self, words: list[str]) -> np.ndarray:
        """Each word's label scores; they are remembered, 300,000 words and one call's at most."""
        if len(self.known) > 300_000:
            self._forget()
        get = self.known.get
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            new = list(dict.fromkeys(w for w, i in zip(words, ids, strict=True) if i < 0))
            slot, owner = slots_of(new, self.lexicon)
            share = np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(new))))
            held = len(self.known)
            self.table = np.concatenate([self.table[:held], np.stack([np.bincount(owner, self.weights[slot, j], len(new)) / share for j in range(len(self.labels))], axis=1)])
            self.known.update(zip(new, range(held, held + len(new)), strict=True))
            ids = [get(w) for w in words]
        return self.table[ids]

    def tag(self, texts: list[list[str]]) -> np.ndarray:
        """Label probabilities of all words of all texts, one after the other."""
        lengths = np.array([len(t) for t in texts], int)
        if not lengths.sum():
            return np.zeros((0, len(self.labels)))
        return forward_backward(self.scores([w for t in texts for w in t]), lengths[lengths > 0], self.trans, self.start)[0]


def fit_field(rows: list[tuple[str, str]], min_count: int = 3, rounds: int = 30, seed: int = 5) -> Field:
    """Fits weights and transitions by gradient ascent on the likelihood of labelled texts (AdaGrad; a little decay).

    rows: (text, label); each word of a text has the text's label. lexicon: words seen min_count times. So that transitions are
    learned from switches too, half of the texts of a step are spliced: two are cut at random and their ends exchanged.
    """
    labels = sorted({label for _, label in rows})
    split = [(words_of(text), labels.index(label)) for text, label in rows]
    split = [(w, y) for w, y in split if w]
    k = len(labels)
    count: dict[str, int] = {}
    for words, _ in split:
        for w in words:
            count[w] = count.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in count.items() if n >= min_count))}
    field = Field(labels, np.zeros((TABLE + len(lexicon), k)), lexicon, np.zeros((k, k)), np.zeros(k))
    if k < 2 or not split:
        return field
    names = sorted(count)
    index = {w: i for i, w in enumerate(names)}
    flat, owner = slots_of(names, lexicon)
    share = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(names))))[:, None]
    by_label = lambda ids, values, n: np.stack([np.bincount(ids, values[:, j], n) for j in range(k)], axis=1)
    rng, batches = np.random.default_rng(seed), max(1, len(split) // 150)
    sums = np.full(field.weights.shape, 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
    dealt = np.array_split(rng.permutation(len(split)), batches)
    for step in range(max(rounds, batches)):
        coded = [(np.array([index[w] for w in split[i][0]]), np.full(len(split[i][0]), split[i][1])) for i in dealt[step % batches]]
        own, half = [], len(coded) // 4
        for (a, ya), (b, yb) in zip(coded[:half], coded[half : 2 * half], strict=True):
            i, j = int(rng.integers(1, len(a) + 1)), int(rng.integers(0, len(b)))
            own += [(np.concatenate([a[:i], b[j:]]), np.concatenate([ya[:i], yb[j:]]))] + ([(np.concatenate([b[:j], a[i:]]), np.concatenate([yb[:j], ya[i:]]))] if j or i < len(a) else [])
        own += coded[2 * half :]
        lengths = np.array([len(w) for w, _ in own])
        ids, gold = np.concatenate([w for w, _ in own]), np.concatenate([y for _, y in own])
        scores = by_label(owner, field.weights[flat], len(names)) * share
        probs, expected = forward_backward(scores[ids], lengths, field.trans, field.start)
        error = -probs
        error[np.arange(len(gold)), gold] += 1
        by_word = by_label(ids, error, len(names)) * share
        grad = by_label(flat, by_word[owner], len(field.weights)) - 1e-3 * field.weights
        firsts = np.cumsum(lengths) - lengths
        inner = np.ones(len(gold), bool)
        inner[firsts] = False
        at = np.flatnonzero(inner)
        moves = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k) - expected
        starts = np.bincount(gold[firsts], minlength=k) - probs[firsts].sum(axis=0)
        for held, total, g, rate in ((field.weights, sums[0], grad, 0.5), (field.trans, sums[1], moves, 0.5), (field.start, sums[2], starts, 0.1)):
            total += g * g
            held += rate * g / np.sqrt(total)
    return field


def tag_languages(docs: DataFrame, learn: DataFrame, sample_rows: int = 1200, sample_chars: int = 20_000, label_rows: int = 20, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, lang, score, n_words, n_switched, shares) for each row of docs.

    The field is fitted on sample_rows labelled rows of learn, the same number of each label as far as there
    are, and label_rows of each where labels are many, in the order of a hash of id and text, repeated rows
    once, among texts of up to sample_chars characters, all taken whole: the greater of sample_rows (and a row
    a label) and label_rows * labels, times sample_chars, bounds what the driver gets. No label is left out.
    Every row of docs is then tagged whole.

    lang: the label with most expected words, `und` for a null text or one without letters (score 0);
    score: its share of the words, 0 to 1; n_switched: words whose likeliest label is another one; shares: of
    all labels, in their order. Without labelled rows all is `und`. Repeated rows are tagged alike.
    """
    spark = docs.sparkSession
    usable = learn.where(F.col(label).isNotNull() & (F.length(text) > 0) & (F.length(text) <= sample_chars)).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.col(doc_id).cast("string"), F.xxhash64(text)).alias("order"))
    labels = usable.select("label").distinct().count()
    sample = first_by_hash(usable, "order", max(label_rows, -(-sample_rows // max(labels, 1))), of="label").collect()
    field = fit_field([(r["text"], r["label"]) for r in sorted(sample, key=lambda r: (r["label"], r["order"]))])
    model = spark.sparkContext.broadcast(field)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        kinds = [("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("n_switched", pa.int64()), ("shares", pa.list_(pa.float64()))]

        def decided(names: list, texts: list[list[str]]) -> pa.RecordBatch:
            probs, at, out = own.tag(texts), 0, []
            for words in texts:
                p = probs[at : at + len(words)]
                at += len(words)
                if not len(p) or not own.labels:
                    out.append(("und", 0.0, len(words), 0, []))
                    continue
                share = p.mean(axis=0)
                best = int(share.argmax())
                out.append((own.labels[best], float(min(1.0, share[best])), len(words), int((p.argmax(axis=1) != best).sum()), share.tolist()))
            columns = [names, *map(list, zip(*out, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

        for b in batches:
            names, texts, size = [], [], 0
            for name, x in zip(b.column(0).to_pylist(), tokens.utf8(b.column(1)), strict=True):
                names.append(name)
                texts.append(words_of(x.decode()) if x else [])
                size += len(texts[-1])
                if size > 150_000:
                    yield decided(names, texts)
                    names, texts, size = [], [], 0
            if names:
                yield decided(names, texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tagged, "doc_id long, lang string, score double, n_words long, n_switched long, shares array<double>")
