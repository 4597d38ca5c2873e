"""Personal data in texts, by weak supervision.

Strict patterns give the base spans, which always stay.  Looser candidates are
voted on by labelers (pattern, check digits, gazetteer, context); expectation
maximisation over the counts of vote patterns estimates how reliable each
labeler is, and its posteriors train a logistic span classifier that decides
which further candidates are added.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import id_and_text, keep, plain_names, tidy

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "word", "neighbour")
#: How much the check counts before its reliability is known, by kind: numbers that fail it are no address or card.
CHECK_FIRST = (1.0, 4.0, 4.0, 1.0)
#: Values of the span's own features.
FEATURES = 6
#: Posterior from which a candidate outside the base spans is added.
ADD_FROM = 0.9
#: Characters before a candidate in which context words are looked for.
REACH = 40

# Domains, issuer digits and context words of the gazetteer and context labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn br ru in ch se no pl".split())
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|addr|login)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|tel[eé]fono|telefon)\b", re.I),
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9][0-9 ().-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LOCAL_PHONE = re.compile(r"(?<![0-9])[0-9]{3}\)? ?[.-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63})+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done, True
        at = text.find("@", max(at + 1, done))


def spans_of(text: str | None):
    """(kind number, start, end, in base) of every candidate, in no order."""
    if not text:
        return
    if "@" in text:
        for s, e, ok in _emails(text):
            yield 0, s, e, ok
    if ("(" in text or "[" in text) and "at" in text.lower():
        for m in _SPELLED.finditer(text):
            yield 0, m.start(), m.end(), False
    for region in _NUMBERS.finditer(text):
        s, e = region.span()
        if e - s < 7:
            continue
        for m in _IP.finditer(text, s, e):
            yield 1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))
        for m in _CARD.finditer(text, s, e):
            if m.end() - m.start() >= 13:
                digits = re.sub("[ -]", "", m[0])
                if 13 <= len(digits) <= 19:
                    yield 2, m.start(), m.end(), luhn(digits)
        if s and text[s - 1] == "+":
            body = region[0].rstrip(" ().-")
            if len(body) >= 3:
                yield 3, s - 1, s + len(body), 9 <= sum(c.isdigit() for c in body) <= 15
        else:
            for m in _LOCAL_PHONE.finditer(text, s, e):
                yield 3, m.start() - (m.start() > 0 and ")" in m[0] and text[m.start() - 1] == "("), m.end(), False


def votes(text: str, kind: int, s: int, e: int, base: bool) -> int:
    """The kind, the labelers' votes (each -1, 0 or 1) and features of the span, as one number."""
    span, before, after = text[s:e], text[max(0, s - REACH) : s], text[e : e + 1]
    # "pattern" looks at the shape alone and "check" at the numbers, so neither repeats the other
    if kind == 0:
        shape = base
        known = 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in TOP_DOMAINS else -1
        plain = span if base else re.sub(r" ?[\[(] ?dot ?[\])] ?", ".", re.sub(r" ?[\[(] ?at ?[\])] ?", "@", span, flags=re.I), flags=re.I)
        check = 1 if ".." not in plain and re.fullmatch(r"[A-Za-z0-9].{0,63}@.{4,253}", plain, re.S) else -1
    elif kind == 1:
        shape = all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in span.split("."))
        first = int(span.split(".")[0][-4:] or 0)
        known = -1 if first in (0, 127) or first >= 224 else 1
        check = 1 if base else -1
    elif kind == 2:
        groups = [len(g) for g in re.split("[ -]", span)]
        shape = len(groups) == 1 or (len(set(re.findall("[ -]", span))) == 1 and (set(groups[:-1]) == {4} or groups in ([4, 6, 5], [4, 6, 4])))
        known = 1 if span[0] in "3456" else -1
        check = 1 if base else -1
    else:
        n = sum(c.isdigit() for c in span)
        shape = base
        check = 1 if 10 <= n <= 13 else -1
        known = 1 if span[0] == "+" and span[1] != "0" else 0
    word = 1 if CONTEXT[KINDS[kind]].search(before) else 0
    near = before[-1:] + after
    neighbour = -1 if any(c.isalnum() or c in "_=\"'#" for c in near) else 1 if all(c.isspace() for c in near) else 0
    code = kind
    for v in (1 if shape else -1, check, known, word, neighbour):
        code = code * 3 + v + 1
    # features of the span that no labeler sees: its length by thirds of the usual range, and whether it has separators
    size = (e - s > (14, 9, 16, 12)[kind]) + (e - s > (22, 12, 18, 15)[kind])
    return code * FEATURES + 2 * size + any(c in " -()" for c in span)


@tidy()
def _candidates(batches):
    out = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())])))])
    for batch in batches:
        texts, found = batch.column("text"), []
        for t in texts:
            t = t.as_py()
            found.append([{"kind": k, "start": s, "end": e, "base": b, "code": votes(t, k, s, e, b)} for k, s, e, b in spans_of(t)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, out.field(1).type)], schema=out)


FOUND = "doc_id long, found array<struct<kind:int,start:int,end:int,base:boolean,code:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Every candidate span of every text with its votes; kept in the shared folder."""
    return keep(id_and_text(docs).mapInArrow(_candidates, FOUND), "spans")


def unpack(code: int) -> tuple[int, list[int], int]:
    """Kind, votes and features."""
    code, features = divmod(code, FEATURES)
    v = []
    for _ in LABELERS:
        code, r = divmod(code, 3)
        v.append(r - 1)
    return code, v[::-1], features


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation of a two-class model with independent labelers.

    patterns: (n, labelers) votes; ``weight`` is how much each labeler counts in the first guess.  Returns the posterior of each pattern and the
    vote probabilities (class, labeler, vote).
    """
    weight = np.ones(patterns.shape[1]) if weight is None else weight
    posterior = 1 / (1 + np.exp(-2.0 * patterns @ weight))
    prior_votes = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])  # labelers are thought better than chance
    for _ in range(rounds):
        p = np.empty((2, patterns.shape[1], 3))
        for y, w in enumerate((counts * (1 - posterior), counts * posterior)):
            for v in (-1, 0, 1):
                p[y, :, v + 1] = ((patterns == v) * w[:, None]).sum(0) + prior_votes[y, v + 1]
        p /= p.sum(2, keepdims=True)
        share = np.array([(counts * (1 - posterior)).sum() + 1, (counts * posterior).sum() + 1])
        logs = np.log(share / share.sum())[:, None] + sum(np.log(p[:, j, patterns[:, j] + 1]) for j in range(patterns.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, p


def _features(kind: np.ndarray, v: np.ndarray, of_span: np.ndarray) -> np.ndarray:
    """The classifier sees the span itself beside the votes, by kind."""
    return np.concatenate([np.eye(len(KINDS) * FEATURES)[kind * FEATURES + of_span], v == 1, v == -1, np.ones((len(v), 1))], axis=1).astype(float)


def fit(found: DataFrame) -> list[int]:
    """The vote codes whose spans are added, learned from all candidates.

    What comes to the driver is a count for each code: at most kinds x 3^labelers
    x features rows (5832), whatever the size of the corpus.
    """
    counted = found.select(F.explode("found.code").alias("code")).groupBy("code").count().collect()
    if not counted:
        return []
    codes = sorted((r["code"], r["count"]) for r in counted)
    return [c for (c, _), q in zip(codes, chances(codes)) if q >= ADD_FROM]


def chances(codes: list[tuple[int, int]]) -> np.ndarray:
    """How likely spans of each vote code are personal data, from the (code, count) of all candidates.

    A code weighs by its share of all candidates, at every size of the corpus.
    """
    kind = np.array([unpack(c)[0] for c, _ in codes])
    v = np.array([unpack(c)[1] for c, _ in codes])
    n = np.array([k for _, k in codes], float)
    target = np.zeros(len(codes))
    for k in set(kind.tolist()):
        of = kind == k
        target[of] = reliabilities(v[of], n[of], weight=np.array([1.0, CHECK_FIRST[k], 1.0, 1.0, 1.0]))[0]
    x, w = _features(kind, v, np.array([unpack(c)[2] for c, _ in codes])), n / n.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(60):  # Newton steps of a ridge-penalised logistic model
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - target)) + 1e-3 * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        beta -= np.linalg.solve(h, g)
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def _digest(spans) -> str:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def detect(docs: DataFrame) -> DataFrame:
    """Base and added spans of every text.

    Null and empty texts have none (counts 0, digest of the empty string); repeated
    rows and null identifiers give a row each; further columns are ignored.
    """
    found = candidates(docs)
    added = fit(found)
    spans = F.array_sort(F.filter("found", lambda s: s["base"] | s["code"].isin(added)) if added else F.filter("found", lambda s: s["base"]))
    base = F.array_sort(F.filter("found", lambda s: s["base"]))
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_digest(base).cast("binary"), 256).alias("base_sha256"), _digest(spans).alias("spans"))


def masked(text: str | None, added: frozenset[int]) -> str | None:
    """The text with every found span replaced by its kind in brackets."""
    if not text:
        return text
    spans = sorted((s, -e, k) for k, s, e, b in spans_of(text) if b or votes(text, k, s, e, b) in added)
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, -e)
    return "".join([*out, text[at:]]) if spans else text


@tidy()
def _mask(batches, added, column):
    for batch in batches:
        i = batch.schema.get_field_index(column)
        yield batch.set_column(i, column, pa.array([masked(t.as_py(), added) for t in batch.column(i)], pa.string()))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; every row and column stays."""
    added = fit(candidates(docs))
    rows = plain_names(docs)
    return rows.mapInArrow(partial(_mask, added=frozenset(added), column="text"), rows.schema).toDF(*docs.columns)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
