"""Language identification of mixed text.

Letter trigrams (with the word's borders) of the training documents give each language a model; a word's score is the sum of
its trigrams' log-probabilities. The script of a word, told by its byte ranges, narrows the candidates to languages written
in it. Viterbi over the words, with a penalty for each switch, labels spans; the text's language is that of most letters.

Where no stretch of words gains half the penalty against the text's best single language, no path with a switch can win;
that is decided for many texts at once, and the others go through Viterbi.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, text_or_empty
from .textkit import buffers, mix, slices

#: Hashed trigrams, pseudo-count of one, penalty of a switch in nats, share of a language's words that makes a script its own.
TRIGRAMS, PSEUDO, SWITCH, OWN_SCRIPT = 1 << 18, 0.5, 14.0, 0.01
#: First byte of a word's first letter beyond ASCII -> script. Fixed ranges of UTF-8 lead bytes.
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other")
_RANGES = (("greek", 0xCE, 0xCF), ("cyrillic", 0xD0, 0xD3), ("hebrew", 0xD7, 0xD7), ("arabic", 0xD8, 0xDB), ("indic", 0xE0, 0xE0), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9), ("hangul", 0xEA, 0xED), ("other", 0xEE, 0xF4))
_SCRIPT = np.zeros(256, np.int8)
for _name, _a, _b in _RANGES:
    _SCRIPT[_a : _b + 1] = SCRIPTS.index(_name)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Characters led by C2 (U+0080 on) and E2 (U+2000 on) that are letters, or marks within the alphabets from U+2C00 on.
_LETTER_C2 = np.array([chr(c).isalpha() for c in range(0x80, 0xC0)])
_LETTER_E2 = np.array([chr(c).isalpha() or c >= 0x2C00 and unicodedata.category(chr(c))[0] == "M" for c in range(0x2000, 0x3000)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray):
    """Trigram bucket of each byte of a word (-1 elsewhere); starts and ends of words; the text of each; its script."""
    letter = _LETTER[data]
    mark = np.flatnonzero((data == 0xE2) | (data == 0xC2))  # most are punctuation and signs
    one, two = (data[np.minimum(mark + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2))
    mark = mark[~np.where(data[mark] == 0xE2, _LETTER_E2[one << 6 | two], _LETTER_C2[one])]
    for k in (0, 1, 2):
        at = mark + k
        at = at[(at < len(data))]
        letter[at[(data[at] >= 0x80) & ((k < 2) | (data[at - k] == 0xE2))]] = False
    low = np.where(letter, _LOWER[data], 32).astype(np.uint8)
    up = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3)) + 1  # capitals of Latin-1
    low[up] += 0x20
    before, after = np.full(len(low), 32, np.uint32), np.full(len(low), 32, np.uint32)
    before[1:], after[:-1] = low[:-1], low[1:]
    inner = off[(off > 0) & (off < len(data))]
    before[inner], after[inner - 1] = 32, 32
    gram = ((mix((before << 16 | low.astype(np.uint32) << 8 | after).astype(np.uint64) + np.uint64(1))) >> np.uint64(46)).astype(np.int32)
    gram[~letter] = -1
    start = np.flatnonzero(letter & (before == 32))
    end = np.flatnonzero(letter & (after == 32)) + 1
    far = _SCRIPT[data].astype(np.int8)
    far[~letter] = 0
    script = np.maximum.reduceat(far, start) if len(start) else np.zeros(0, np.int8)
    return gram, start, end, np.searchsorted(off, start, "right") - 1, script


def fit(docs: DataFrame) -> dict:
    """Learn from text and lang of all given rows with a non-null lang. The driver sees counts by language and bucket."""
    rows = docs.filter("lang IS NOT NULL").select("lang", text_or_empty().alias("text"))
    langs = [r["lang"] for r in rows.groupBy("lang").count().orderBy("lang").collect()]
    if len(langs) > 500:
        raise ValueError(f"{len(langs)} languages")
    width = TRIGRAMS + len(SCRIPTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), width), np.int64)
        number = {x: i for i, x in enumerate(langs)}
        for b in batches:
            lang = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            data, off = buffers(b.column(1))
            for s, e in slices(off):
                part = data[off[s] : off[e]]
                if not len(part):
                    continue
                o = off[s : e + 1] - off[s]
                gram, start, _, text, script = words(part, o)
                own = np.repeat(lang[s:e], np.diff(o))
                for i in np.unique(lang[s:e]):
                    total[i, :TRIGRAMS] += np.bincount(gram[(own == i) & (gram >= 0)], minlength=TRIGRAMS)
                    total[i, TRIGRAMS:] += np.bincount(script[lang[s:e][text] == i], minlength=len(SCRIPTS))
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64) * width + j), pa.array(total[i, j])], ["at", "n"])

    total = np.zeros(len(langs) * width)
    for r in rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # one row a language and bucket
        total[r["at"]] = r["n"]
    total = total.reshape(len(langs), width)
    grams, scripts = total[:, :TRIGRAMS] + PSEUDO, total[:, TRIGRAMS:]
    table = np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32) if langs else grams.astype(np.float32)
    own = scripts >= OWN_SCRIPT * np.maximum(scripts.sum(1, keepdims=True), 1)
    own[:, ~own.any(0)] = True  # a script of no language leaves all as candidates
    return {"langs": langs, "table": np.hstack((table, np.zeros((len(langs), 1), np.float32))), "own": own}


def viterbi(score: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word (rows of ``score``), each change costing ``switch``."""
    n, k = score.shape
    best, back = score[0].copy(), np.zeros((n, k), np.int16)
    own = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - switch > best
        back[i] = np.where(jump, top, own)
        best = np.where(jump, best[top] - switch, best) + score[i]
    out = np.empty(n, np.int16)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def label(model: dict, data: np.ndarray, off: np.ndarray, switch: float = SWITCH):
    """Starts and ends of the words, the text and the language of each."""
    gram, start, end, text, script = words(data, off)
    k = len(model["langs"])
    if not len(start):
        return start, end, text, np.zeros(0, np.int16)
    score = np.stack([np.add.reduceat(model["table"][i][gram], start) for i in range(k)], 1).astype(np.float64)
    score -= score.max(1, keepdims=True)
    score[~model["own"].T[script]] = -1e4
    first = np.searchsorted(text, np.arange(len(off)))
    full = np.flatnonzero(np.diff(first))
    single = np.add.reduceat(score, first[full], axis=0).argmax(1)
    lang = np.zeros(len(start), np.int16)
    lang[:] = np.repeat(single, np.diff(first)[full])
    gain = score - score[np.arange(len(score)), lang][:, None]
    # largest sum of a stretch of words: run over all texts at once, a large negative step between texts keeps them apart
    step = gain.copy()
    step[first[full]] -= 1e9
    total = np.cumsum(step, 0)
    low = np.minimum.accumulate(np.vstack((np.zeros((1, k)), total[:-1])), 0)
    low[first[full]] = total[first[full]] - gain[first[full]]
    low = np.minimum.accumulate(low, 0)
    most = np.maximum.reduceat((total - low).max(1), first[full])
    for t in full[most > switch / 2]:
        a, b = first[t], first[t + 1]
        lang[a:b] = viterbi(score[a:b], switch)
    return start, end, text, lang


def identify(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """``docs`` with lang_pred, score and spans (array of first word, words, lang).

    ``score`` is the share of letters in spans of lang_pred. ``und`` with score 0 is for texts that are null or hold no
    letter, and for a model that learnt from nothing. Rows are labelled one by one: repeated rows get the same label, and
    columns other than text are passed through (those named like a result are replaced).
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    docs = docs.select(*names)
    item = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])
    at_text, langs = names.index("text"), model["langs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(at_text))
            pred, score, spans = ["und"] * b.num_rows, np.zeros(b.num_rows), [[] for _ in range(b.num_rows)]
            for s, e in slices(off):
                part = data[off[s] : off[e]]
                if not len(part) or not langs:
                    continue
                start, end, text, lang = label(model, part, off[s : e + 1] - off[s], switch)
                if not len(start):
                    continue
                weight = np.zeros((e - s, len(langs)))
                np.add.at(weight, (text, lang), end - start)
                all_, best = weight.sum(1), weight.argmax(1)
                new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (lang[1:] != lang[:-1]))))
                first = np.searchsorted(text, text[new])
                for i, n, f in zip(new, np.diff(np.append(new, len(text))), first):
                    spans[s + text[i]].append({"first": int(i - f), "words": int(n), "lang": langs[lang[i]]})
                head = part[start[np.searchsorted(text, np.arange(e - s)).clip(max=len(start) - 1)]]
                for i in np.flatnonzero(all_):
                    if head[i] >= 0x80 and not any(c.isalpha() for c in part[off[s + i] - off[s] : off[s + i + 1] - off[s]].tobytes().decode("utf-8", "ignore")):
                        spans[s + i] = []  # signs beyond ASCII that are no letters
                        continue
                    pred[s + i], score[s + i] = langs[best[i]], weight[i, best[i]] / all_[i]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(score), pa.array(spans, pa.list_(item))], [*names, "lang_pred", "score", "spans"])

    return docs.mapInArrow(run, added(docs, lang_pred="string", score="double", spans="array<struct<first:int,words:int,lang:string>>"))
