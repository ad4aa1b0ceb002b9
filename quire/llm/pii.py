"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (``email``, ``ip``, ``card``, ``phone``) come from fixed patterns and always stay. Beside
them wider patterns propose candidates: written-out addresses, long digit groups, telephone
numbers without a country code, dotted numbers, and long mixed strings (``secret``). Seven labelers vote yes,
no or nothing on every base span and candidate: two look at its form (regex), two at word lists of
cues around it (gazetteer), three at its surroundings and the rest of the document (context). Expectation-maximisation estimates each
labeler's reliability per kind from the votes alone, and the resulting probabilities train a logistic
span classifier on features of the span. Candidates it gives ``LEAST`` or more are added, if
they overlap no base span and no added span before them.

What the corpus gives to the estimate are the counts of vote and feature patterns, which are sums over
all documents. There are a few thousand patterns at most, whatever the size of the corpus.
Null and empty texts have no spans. Repeated rows are searched each, and every number of
spans per text works. Places are code points; ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LEAST = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|(?i:[(\[ ](?:at|dot)[)\] ])")

SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}+){1,4}+", re.I)
MIXED = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+")
NATIONAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,5}\)?(?:[ ./-]\(?[0-9]{2,5}\)?){1,4}(?![0-9])")

#: Cue words before a span, by kind, and words that speak against any.
CUES = {
    "email": frozenset("email e-mail mail contact write courriel correo kontakt".split()),
    "ip": frozenset("ip host server address client adresse dirección from".split()),
    "card": frozenset("card visa mastercard credit carte karte tarjeta number account iban".split()),
    "phone": frozenset("phone tel telephone call fax mobile téléphone telefon teléfono appelez".split()),
    "secret": frozenset("token key secret password passwd api apikey bearer auth".split()),
}
AGAINST = frozenset("version license licence page pages chapter isbn issn section figure table vol article § $ € eur usd".split())
HOSTS = re.compile(r"\.(?:com|org|net|edu|gov|de|fr|es|io|info)$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: a match starts where the run of local characters before its @ does."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "email": emails(text),
        "ip": [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15],
    }


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """What the wider patterns propose."""
    for m in SPOKEN.finditer(text):
        yield "email", *m.span()
    for m in IP.finditer(text):
        yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 13 <= len(_digits(m[0])) <= 19:
            yield "card", *m.span()
    for m in NATIONAL.finditer(text):
        if 7 <= len(_digits(m[0])) <= 12:
            yield "phone", *m.span()
    for m in MIXED.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            yield "secret", *m.span()


def _words_before(text: str, start: int) -> list[str]:
    return [w.strip(".,:;=()[]\"'|#").lower() for w in text[max(0, start - 60) : start].split()[-4:]]


def judge(text: str, kind: str, start: int, end: int, is_base: bool, seen: Counter) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes (1, -1 or 0) of the labelers, and the features of the span."""
    s, digits = text[start:end], _digits(text[start:end])
    before, after = text[start - 1 : start], text[end : end + 1]
    cues = _words_before(text, start)
    valid = {
        "email": bool(HOSTS.search(s.rstrip("."))) or " dot " in s.lower(),
        "ip": all(int(x[-9:]) <= 255 for x in s.split(".")) if kind == "ip" else False,
        "card": luhn(digits),
        "phone": 8 <= len(digits) <= 15,
        "secret": len(s) >= 24 and len(set(s)) >= 10,
    }[kind]
    alone = (not before or before.isspace() or before in "\"'(|:=") and (not after or after.isspace() or after in "\"').,;|:")
    near_digits = sum(c.isdigit() for c in text[max(0, start - 12) : start] + text[end : end + 12])
    cue = any(c in CUES[kind] for c in cues)
    against = any(c in AGAINST for c in cues)
    votes = (
        1 if is_base else -1,  # the strict pattern
        1 if valid else -1,  # checksum, ranges, lengths, top-level domain
        1 if cue else 0,  # cue words of the kind
        -1 if against else 0,  # words of references and amounts
        1 if alone else -1,  # stands alone between blanks, quotes or punctuation
        -1 if near_digits > 3 else 0,  # one number in a row of numbers
        1 if seen[s] > 1 else 0,  # comes again in the document
    )
    features = (
        min(3, len(digits) // 6),
        min(3, len(s) // 12),
        int(len(digits) * 2 >= len(s)),
        int(any(c in " -().@" for c in s)),
        int(alone),
        int(cue),
        int(against),
        int(valid),
        int(near_digits > 3),
    )
    return votes, features


def judged(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int, bool, tuple, tuple]]]:
    """Base spans, and every base span and candidate with votes and features, by kind and start."""
    if not ANY.search(text):
        return {k: [] for k in BASE_KINDS}, []
    base = base_spans(text)
    spans = {(k, a, b): True for k, v in base.items() for a, b in v}
    taken = sorted((a, b) for v in base.values() for a, b in v)
    starts = [a for a, _ in taken]
    from bisect import bisect_left

    reach, most = [], 0
    for _, b in taken:
        reach.append(most := max(most, b))
    for k, a, b in candidates(text):
        i = bisect_left(starts, b)
        if not (i and reach[i - 1] > a):
            spans.setdefault((k, a, b), False)
    seen = Counter(text[a:b] for _, a, b in spans)
    ordered = sorted(spans.items(), key=lambda x: (KINDS.index(x[0][0]), x[0][1:]))
    return base, [(k, a, b, own, *judge(text, k, a, b, own, seen)) for (k, a, b), own in ordered]


def reliabilities(votes: np.ndarray, counts: np.ndarray, prior: float = 0.5, rounds: int = 50) -> np.ndarray:
    """EM over vote patterns (rows of -1, 0, 1) seen ``counts`` times: the probability that a pattern's spans are personal data."""
    n_labelers = votes.shape[1]
    hit = np.clip((votes.sum(1) + 1.0) / (n_labelers + 1) + 0.3, 0.05, 0.95)  # start: the majority
    for _ in range(rounds):
        logs = []
        for p in (hit, 1 - hit):
            weight = (p * counts)[:, None]
            odds = np.stack([((votes == v) * weight).sum(0) + 1.0 + 2.0 * (agree == v) for v, agree in ((-1, 0), (0, 0), (1, 0))], 0)
            odds /= odds.sum(0)
            logs.append(np.log(odds[votes + 1, np.arange(n_labelers)]).sum(1))
        share = (hit * counts).sum() / counts.sum()
        share = min(0.95, max(0.05, 0.9 * share + 0.1 * prior))
        new = 1 / (1 + np.exp(np.clip(logs[1] + np.log(1 - share) - logs[0] - np.log(share), -30, 30)))
        if np.abs(new - hit).max() < 1e-6:
            break
        hit = new
    return hit


def one_hot(features: np.ndarray) -> np.ndarray:
    """Indicator columns of the feature values, and a constant."""
    levels = (4, 4, 2, 2, 2, 2, 2, 2, 2)
    return np.concatenate([np.ones((len(features), 1))] + [(features[:, j, None] == np.arange(1, n)) for j, n in enumerate(levels)], 1).astype(float)


def logistic(x: np.ndarray, goal: np.ndarray, counts: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression on probabilities, by Newton steps."""
    weight, w = counts / counts.sum() * len(counts), np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - goal)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def patterns(docs: DataFrame) -> DataFrame:
    """``kind, votes, features, n``: how often each pattern occurs in all texts, summed in the tasks first."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                count.update((k, v, f) for k, *_, v, f in judged(text.as_py() or "")[1])
        if count:
            kinds, votes, features = zip(*count, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array([",".join(map(str, v)) for v in votes]), pa.array([",".join(map(str, f)) for f in features]), pa.array(list(count.values()), pa.int64())], ["kind", "votes", "features", "n"]
            )

    return docs.select("text").mapInArrow(run, "kind string, votes string, features string, n long").groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


Model = dict[str, np.ndarray]


def fit(docs: DataFrame) -> Model:
    """Weights of the span classifier per kind, from all texts. A kind without any span has none and adds none."""
    rows, model = patterns(docs).orderBy("kind", "votes", "features").collect(), {}
    for kind in KINDS:
        own = [r for r in rows if r["kind"] == kind]
        if own:
            votes = np.array([[int(v) for v in r["votes"].split(",")] for r in own])
            features = np.array([[int(v) for v in r["features"].split(",")] for r in own])
            counts = np.array([r["n"] for r in own], float)
            model[kind] = logistic(one_hot(features), reliabilities(votes, counts), counts)
    return model


def added_spans(found: list, model: Model, least: float = LEAST) -> list[tuple[str, int, int]]:
    """Candidates of ``judged`` that the classifier accepts, leftmost first where they overlap."""
    open_ = [(k, a, b, f) for k, a, b, own, _, f in found if not own and k in model]
    if not open_:
        return []
    good = []
    for k in {x[0] for x in open_}:
        part = [x for x in open_ if x[0] == k]
        p = 1 / (1 + np.exp(-np.clip(one_hot(np.array([x[3] for x in part])) @ model[k], -30, 30)))
        good += [x[:3] for x, q in zip(part, p, strict=True) if q >= least]
    out, end = [], -1
    for k, a, b in sorted(good, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if a >= end:
            out.append((k, a, b))
            end = b
    return out


def spans_of(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, by kind and start."""
    base, found = judged(text)
    own = [(k, a, b) for k in BASE_KINDS for a, b in base[k]]
    return own, sorted(own + added_spans(found, model), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans`` of every row of ``docs(doc_id, text)``."""
    ready(docs.sparkSession)
    model = fit(docs) if model is None else model
    names = ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                own, spans = spans_of(text.as_py() or "", model)
                n = Counter(k for k, *_ in own)
                rows.append((*[n[k] for k in BASE_KINDS], hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    schema = ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(text: str, model: Model) -> str:
    """The text with its kind in place of each span; overlapping spans are replaced together, by the first one's kind."""
    out, at = [], 0
    for k, a, b in sorted(spans_of(text, model)[1], key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with all its columns, ``text`` without personal data; null texts stay null. ``n_chars``, where there is one, follows the text."""
    ready(docs.sparkSession)
    model = fit(docs) if model is None else model
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t.as_py() is None else redact(t.as_py(), model) for t in batch.column("text")]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
