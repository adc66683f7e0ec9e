"""Languages of documents and of their segments: a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Two-letter code, three-letter codes and English name of languages a label may name.
NOTATIONS = """
en eng English; de deu ger German; fr fra fre French; es spa Spanish; pt por Portuguese; it ita Italian; nl nld dut Dutch; ru rus Russian; ja jpn Japanese;
zh zho chi Chinese; ko kor Korean; ar ara Arabic; hi hin Hindi; bn ben Bengali; pl pol Polish; uk ukr Ukrainian; cs ces cze Czech; sk slk slo Slovak; sl slv Slovenian;
hr hrv Croatian; sr srp Serbian; bg bul Bulgarian; ro ron rum Romanian; hu hun Hungarian; fi fin Finnish; sv swe Swedish; da dan Danish; no nor Norwegian; is isl ice Icelandic;
et est Estonian; lv lav Latvian; lt lit Lithuanian; el ell gre Greek; tr tur Turkish; he heb Hebrew; fa fas per Persian; ur urd Urdu; vi vie Vietnamese; th tha Thai;
id ind Indonesian; ms msa may Malay; tl tgl Tagalog; sw swa Swahili; ca cat Catalan; eu eus baq Basque; gl glg Galician; ga gle Irish; cy cym wel Welsh; la lat Latin;
ta tam Tamil; te tel Telugu; ml mal Malayalam; mr mar Marathi; gu guj Gujarati; pa pan Punjabi; ka kat geo Georgian; hy hye arm Armenian; sq sqi alb Albanian; mk mkd mac Macedonian
"""
CODES = {word.lower(): entry.split()[0] for entry in NOTATIONS.replace("\n", " ").split(";") for word in entry.split()}

WIDTHS, FILTERS, WINDOW, STRIDE = (2, 3, 4), 32, 96, 72
#: Names and codes in brackets belong to the text around them; what is longer than 80 characters is neither.
_BRACKETS = re.compile(r"[(（\[【][^()（）\[\]【】]{0,80}[)）\]】]")
_MARKUP = re.compile(r"<[^<>\n]+>|https?://\S+|&[a-z]{2,6};")
_CUTS = re.compile(r"(?<=[.!?…])[\"'»”’)]*\s+|(?<=[。！？])\s*|[\n\r\v\f  ]+|\s+[/|—–•·]+\s+|\t+")
_LETTER = re.compile(r"[^\W\d_]")
_CJK = r"々-ヿ㐀-鿿"
_SCRIPTS = re.compile(rf"(?<=[{_CJK}])(?=[^\W\d_{_CJK}])|(?<=[A-Za-zÀ-ɏ])(?=[{_CJK}Ѐ-ӿ])|(?<=[Ѐ-ӿ])(?=[{_CJK}A-Za-zÀ-ɏ])")


def code_of(label: str | None) -> str:
    """The two-letter code a label names in any usual notation; empty if it names no language."""
    return CODES.get(re.split(r"[-_ ]", (label or "").strip().lower(), maxsplit=1)[0], "")


def segments(text: str) -> list[str]:
    """The sentences, lines and runs of one script of a text, without markup and what stands in brackets; only those with letters."""
    out = []
    for part in _CUTS.split(_BRACKETS.sub(" ", _MARKUP.sub(" ", text))):
        out += [s for s in (p.strip(" /|—–•·\t") for p in _SCRIPTS.split(part)) if _LETTER.search(s)]
    return out


def windows(texts: list[str], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length byte windows of all texts, and the text each is of. Whole texts are covered."""
    rows, owner = [], []
    for i, t in enumerate(texts):
        b = t.lower().encode("utf-8", "surrogatepass")
        for a in range(0, max(1, len(b) - (WINDOW - STRIDE)), stride):
            rows.append(b[a : a + WINDOW].ljust(WINDOW, b"\0"))
            owner.append(i)
    return np.frombuffer(b"".join(rows), "u1").reshape(-1, WINDOW), np.array(owner, "i8")


class ByteNet:
    """Convolutions of several widths over bytes, max pooling, softmax; trained with Adam."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.taps = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype("f4") for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype("f4")
        self.bias = np.zeros(len(labels), "f4")

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        features, where = [], []
        for w, taps in zip(WIDTHS, self.taps):
            span = WINDOW - w + 1
            y = taps[0][x[:, :span]]
            for k in range(1, w):
                y += taps[k][x[:, k : k + span]]
            at = y.argmax(1)
            where.append(at)
            features.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
        return np.concatenate(features, 1), where

    def scores(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Log probabilities of each label for each window."""
        out = np.zeros((len(x), len(self.labels)), "f4")
        for a in range(0, len(x), block):
            z = np.tanh(self.pooled(x[a : a + block])[0]) @ self.out + self.bias
            z -= z.max(1, keepdims=True)
            out[a : a + block] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.taps, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        share = 1 / np.sqrt(np.bincount(y, minlength=len(self.labels)))[y]  # rare labels come more often
        draw = lambda: rng.choice(len(x), len(x), p=share / share.sum())
        order, a = draw(), 0
        for step in range(1, steps + 1):
            if a >= len(x):
                order, a = draw(), 0
            i = order[a : a + batch]
            a += batch
            f, where = self.pooled(x[i])
            h = np.tanh(f)
            drop = (rng.random(h.shape) >= 0.3).astype("f4") / np.float32(0.7)
            z = (h * drop) @ self.out + self.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p /= len(i)
            g = (p @ self.out.T) * drop * (1 - h * h)
            grads = []
            for n, (w, taps) in enumerate(zip(WIDTHS, self.taps)):
                mine = g[:, n * FILTERS : (n + 1) * FILTERS].ravel()
                spots = [(np.take_along_axis(x[i], where[n] + k, 1).astype("i8") * FILTERS + np.arange(FILTERS)).ravel() for k in range(w)]
                grads.append(np.stack([np.bincount(b, mine, 256 * FILTERS).reshape(256, FILTERS) for b in spots]).astype("f4"))
            grads += [(h * drop).T @ p, p.sum(0)]
            now = rate * (1 - (step - 1) / steps)
            for q, d, mm, vv in zip(params, grads, m, v):
                mm += 0.1 * (d - mm)
                vv += 0.001 * (d * d - vv)
                q -= now * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the index of its label and the probability, by the mean over its windows."""
        x, owner = windows(texts)
        total = np.zeros((len(texts), len(self.labels)))
        np.add.at(total, owner, self.scores(x))
        total /= np.maximum(1, np.bincount(owner, minlength=len(texts)))[:, None]
        p = np.exp(total - total.max(1, keepdims=True)) if len(texts) else total
        p /= p.sum(1, keepdims=True) if len(texts) else 1
        return p.argmax(1), p.max(1)


def train(docs: DataFrame, sample: int = 700, steps: int = 1000, few: int = 50, seed: int = 3) -> ByteNet | None:
    """A network fitted to at most `sample` labelled documents of each language (those with the least hash of their id).

    A label names one of some fifty languages (NOTATIONS), so the driver holds fifty times `sample` documents at most.
    Labels may be wrong: networks fitted to either half judge the other half, and the windows whose label they
    contradict are left out of the final fit, with a language if nothing is left of it. Of a language with less than
    `few` windows in a half, only those contradicted with 0.9 or more: that half can't tell the language well. None
    without any.
    """
    first = F.lower(F.regexp_extract(F.trim("lang"), r"^([^-_ ]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in sorted(CODES.items()) for x in pair])
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang", F.try_element_at(known, first).alias("code")).where("code is not null")
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = sorted(rows.withColumn("place", place).where(F.col("place") <= sample).collect(), key=lambda r: (r.place, r.code, r.doc_id))
    labels = sorted({r.code for r in rows})
    if not labels:
        return None
    texts, y = [], []
    for r in rows:
        for s in segments(r.text):
            texts.append(s)
            y.append(labels.index(r.code))
    if not texts:
        return None
    x, owner = windows(texts, STRIDE // 2)
    target = np.array(y)[owner]
    half = np.random.default_rng(seed).random(len(texts))[owner] < 0.5
    keep = np.ones(len(x), bool)
    if half.any() and not half.all():
        for own in (half, ~half):
            net = ByteNet(labels, seed)
            net.fit(x[own], target[own], steps // 2)
            s = net.scores(x[~own])
            seldom = np.bincount(target[own], minlength=len(labels))[target[~own]] < few
            keep[~own] = (s.argmax(1) == target[~own]) | (seldom & (s.max(1) < np.log(0.9)))
    keep = keep if keep.any() else ~keep
    left, target = np.unique(target[keep], return_inverse=True)
    net = ByteNet([labels[i] for i in left], seed)
    net.fit(x[keep], target, steps)
    return net


def _read_documents(net: ByteNet, sure: float, few: int):
    def judged(texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
        parts = [segments(t) if t else [] for t in texts]
        flat = [s for p in parts for s in p]
        label, sure_of = net.judge(flat) if flat else (np.zeros(0, "i8"), np.zeros(0))
        out, at = [], 0
        for p in parts:
            n = len(p)
            mine, conf = label[at : at + n], sure_of[at : at + n]
            at += n
            letters = np.array([len(_LETTER.findall(s)) for s in p])
            weight = np.zeros(len(net.labels))
            np.add.at(weight, mine, letters * conf)
            main = int(weight.argmax()) if n else -1
            # A segment that is short or unsure speaks the main language of its document.
            plain = [int(m) if k >= few * (0.4 if net.labels[m] in ("ja", "zh", "ko") else 1) and c >= sure else main for m, c, k in zip(mine, conf, letters)]
            out.append([(s, net.labels[m], float(c)) for s, m, c in zip(p, plain, conf)])
        return out

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, label, found in zip(b["doc_id"], b["lang"], judged(list(b["text"]))):
                rows += [(i, label, n, s, lang, c) for n, (s, lang, c) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "segment", "text", "lang_found", "confidence"])

    return read


def document_segments(docs: DataFrame, sample: int = 700, sure: float = 0.8, few: int = 12) -> DataFrame:
    """(doc_id, lang, segment, text, lang_found, confidence): the language of every segment of every document.

    docs has doc_id, text and lang (a label in any notation). A segment is a sentence, line or run of one script;
    names and codes in brackets belong to the text around them. A segment of fewer than `few` letters, or with
    a confidence below `sure`, gets the language of most of its document. Whole texts are read, in fixed-length
    windows that overlap.

    Byte convolutional network (see ByteNet), fitted to a bounded sample of labelled rows (see train).

    Defined cases: null and empty texts, and texts without letters, have no segments; a null label or one that
    names no language only keeps the row from being a sample; without any labelled row there are no segments; an
    empty table gives none; other columns play no part.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    schema = "doc_id bigint, lang string, segment int, text string, lang_found string, confidence double"
    net = train(rows, sample)
    if net is None:
        return docs.sparkSession.createDataFrame([], schema)
    return rows.mapInPandas(_read_documents(net, sure, few), schema)


def wrong_labels(found: DataFrame, sure: float = 0.6) -> DataFrame:
    """(doc_id, lang_found, confidence) of documents with a missing or wrong label or with several languages.

    A label that names one language is wrong only if the confidence in another one is at least `sure`.
    """
    first = F.lower(F.regexp_extract(F.trim(F.coalesce("lang", F.lit(""))), r"^([^-_ ]+)", 1))
    known = F.create_map(*[F.lit(x) for pair in sorted(CODES.items()) for x in pair])
    named = F.coalesce(F.try_element_at(known, first), F.lit(""))
    each = found.groupBy("doc_id", "lang_found").agg(F.max("confidence").alias("confidence"), F.first(named).alias("named"))
    all_ = each.groupBy("doc_id").agg(F.collect_list(F.struct("lang_found", "confidence")).alias("langs"), F.first("named").alias("named"))  # a row for each language
    wrong = all_.where((F.size("langs") > 1) | ((F.col("named") != F.get("langs", F.lit(0))["lang_found"]) & ((F.col("named") == "") | (F.get("langs", F.lit(0))["confidence"] >= sure))))
    return wrong.select("doc_id", F.explode("langs").alias("l")).select("doc_id", "l.lang_found", "l.confidence")
