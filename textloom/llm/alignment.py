"""Alignment of two tokenizers' tokens over whole texts, and how often pairs of ids end together."""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left, bisect_right
from functools import partial
from itertools import accumulate
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import CACHES, id_and_text, keep, tidy
from .tokens import _byte_names

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units that a worker remembers in each of two generations, and the longest that it remembers.
CACHE_UNITS, CACHE_CHARS = 200_000, 200
#: Characters whose units are looked up at once.
SLICE = 1 << 19
#: Before one space or line end between two other characters (U+180E is white space for some libraries), and
#: between a letter and a mark: neither tokenizer joins what stands before to what stands after.
CUT = re.compile("(?<=[^\\s᠎])(?=[ \n][^\\s᠎])|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,!?;:|])")
#: One word for the first tokenizer.
WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: What no piece of the second vocabulary may hold for CUT to be right.
JOINED = re.compile("[^▁]▁|\n|[A-Za-zÀ-ÖØ-öø-ɏ][.,!?;:|]")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
_PAIRS: dict[tuple[str, str], "Pair"] = {}
CACHES["alignment"] = _PAIRS.clear


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)


def boundaries(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int]]:
    """Tokens of A and of B before each gap that no token spans.

    ``a_ends`` and ``b_ends`` are the byte offsets at which the tokens end; each begins
    where the one before it ends.  The ends of B are a static interval index: bisecting
    it with the range of a token of A gives the first and the last token of B that
    overlap it.  The gap after the token of A is spanned by none if the last one ends
    there too.
    """
    out, start = [], 0
    for i, end in enumerate(a_ends, 1):
        first = bisect_right(b_ends, start)
        last = bisect_left(b_ends, end, first)
        if last < len(b_ends) and b_ends[last] == end:
            out.append((i, last + 1))
        start = end
    return out


class Pair:
    """Both tokenizers, the bytes of their tokens, and alignments of units seen before.

    A unit is a text from one CUT to the next.  The first tokenizer splits a text there; the
    second has no piece that goes across one (JOINED).  So a text's tokens are those of
    its units, and both have a token that ends at each cut.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        plan = json.loads(self.a.to_str())
        byte_of = {c: i for i, c in enumerate(_byte_names())}
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for name, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        splits = plan["pre_tokenizer"] or {}
        self.in_units = plan["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex", False) and not any(JOINED.search(p) for p in pieces)
        if len(self.a_bytes) * len(self.b_bytes) >= 1 << 32:
            raise ValueError("pairs of ids do not fit four bytes")
        self.model, self.shown = self.a.model, _byte_names()
        self.a_sizes, self.b_sizes = ([len(x) for x in names] for names in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (list(map(str, range(len(names)))) for names in (self.a_bytes, self.b_bytes))
        self.now: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def pairs(self) -> int:
        """The most pairs of ids that can end together: of their bytes one ends with the other."""
        a, b = {}, {}
        for table, all_bytes in ((a, self.a_bytes), (b, self.b_bytes)):
            for x in all_bytes:
                table[x] = table.get(x, 0) + 1
        return sum(n * b.get(x[i:], 0) for x, n in a.items() for i in range(len(x))) + sum(n * a.get(x[i:], 0) for x, n in b.items() for i in range(1, len(x)))

    def _aligned(self, unit: str, a: list[int], b: list[int]) -> tuple | None:
        """(tokens of A, of B, groups, groups as text, links), or None if the bytes are not those of the unit."""
        raw = unit.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a_names, b_names, width = list(map(self.a_names.__getitem__, a)), list(map(self.b_names.__getitem__, b)), len(self.b_bytes)
        groups, links, i, j = [], [], 0, 0
        for m, n in boundaries(list(accumulate(map(self.a_sizes.__getitem__, a))), list(accumulate(map(self.b_sizes.__getitem__, b)))):
            groups.append(f"{','.join(a_names[i:m])}|{','.join(b_names[j:n])}")
            links.append(a[m - 1] * width + b[n - 1])
            i, j = m, n
        return len(a), len(b), len(links), ";".join(groups), pack(f"<{len(links)}I", *links)

    def learn(self, units: list[str]) -> dict[str, tuple | None]:
        """Alignments of units.  Within a text a unit without a space has none added: a line end, which
        joins nothing, takes the added space and both are left out."""
        words = [u for u in units if WORD.fullmatch(u)]
        others = [u for u in units if not WORD.fullmatch(u)]
        a = {u: [t.id for t in self.model.tokenize("".join(map(self.shown.__getitem__, u.encode())))] for u in words}
        a.update((u, e.ids) for u, e in zip(others, self.a.encode_batch(others, add_special_tokens=False)))
        spaced = [u[0] == " " or not self.in_units for u in units]
        b = self.b.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced)], num_threads=1)
        return {u: self._aligned(u, a[u], ids if s else ids[2:]) for u, s, ids in zip(units, spaced, b)}

    def look_up(self, wanted: list[list[str]]) -> dict[str, tuple | None]:
        """All units of a slice; long ones are not remembered."""
        now, before = self.now, self.before
        missing = set().union(*wanted).difference(now)
        new = []
        for u in missing:
            if u in before:
                now[u] = before[u]
            else:
                new.append(u)
        found = self.learn(new) if new else {}
        long = {u: x for u, x in found.items() if len(u) > CACHE_CHARS}
        now.update((u, x) for u, x in found.items() if len(u) <= CACHE_CHARS)
        self.now, self.before = ({}, now) if len(now) >= CACHE_UNITS else (now, before)
        return now | long if long else now

    def slices(self, texts):
        """(place of the text, whether it ends here, its next units), in lists of about SLICE characters."""
        out, size = [], 0
        for k, text in enumerate(texts):
            whole = " " + (text or "")
            at = 0
            while at < len(whole):
                end = len(whole)
                if self.in_units and end - at > SLICE and (m := CUT.search(whole, at + SLICE)):
                    end = m.start()
                part = whole[at:end] if text else ""
                out.append((k, end == len(whole), (CUT.split(part) if self.in_units else [part]) if part else []))
                size, at = size + len(part) + 64, end
                if size >= SLICE:
                    yield out
                    out, size = [], 0
        if out:
            yield out

    def aligned(self, texts):
        """For each text in order, its parts: lists of aligned units; None for a part that does not align."""
        for piece in self.slices(texts):
            known = self.look_up([units for _, _, units in piece])
            for k, last, units in piece:
                found = list(map(known.__getitem__, units))
                yield k, last, (None if None in found else found)


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


@tidy("alignment")
def _align(batches, path_a: str, path_b: str):
    pair = pair_of(path_a, path_b)
    for batch in batches:
        rows, texts = [], (t.as_py() for t in batch.column("text"))
        fits, counts, sha, links = True, [0, 0, 0], hashlib.sha256(), []
        for _, last, units in pair.aligned(texts):
            if units is None:
                fits = False
            elif fits and units:
                a, b, g, groups, ends = zip(*units)
                if counts[0]:
                    sha.update(b";")
                sha.update(";".join(groups).encode())
                links.extend(ends)
                for i, n in enumerate((a, b, g)):
                    counts[i] += sum(n)
            if last:
                rows.append((*counts, sha.hexdigest(), b"".join(links)) if fits and counts[0] else (0, 0, 0, "", b""))
                fits, counts, sha, links = True, [0, 0, 0], hashlib.sha256(), []
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.binary())],
            names=[c.split()[0] for c in ALIGNED.split(", ")],
        )


@tidy("alignment")
def _groups(batches, path_a: str, path_b: str):
    pair = pair_of(path_a, path_b)
    for batch in batches:
        out, held = [], []
        for _, last, units in pair.aligned(t.as_py() for t in batch.column("text")):
            held.append(units)
            if last:
                whole = None if None in held else [u[3] for part in held for u in part]
                out.append(None if not whole else ";".join(whole))
                held = []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "groups"])


@tidy()
def _count(batches):
    """How often each link occurs, summed a few million links at a time."""

    def summed(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["link", "n"])

    held, size = [], 0
    for batch in batches:
        for x in batch.column("links"):
            held.append(np.frombuffer(x.as_buffer(), "<u4"))
            size += len(held[-1])
            if size >= 1 << 22:
                yield summed(held)
                held, size = [], 0
    if size:
        yield summed(held)


@tidy()
def _weigh(batches, keys: np.ndarray, counts: np.ndarray, best: np.ndarray):
    for batch in batches:
        n_links, n_best, total = [], [], []
        for x in batch.column("links"):
            at = np.searchsorted(keys, np.frombuffer(x.as_buffer(), "<u4"))
            n_links.append(len(at))
            n_best.append(int(best[at].sum()))
            total.append(int(counts[at].sum()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *(pa.array(v, pa.int64()) for v in (n_links, n_best, total)), batch.column("groups_sha256")],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )


def groups(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id and ``groups``: an array of structs of the ids of A and of B that cover the same bytes.

    Null where a text is null, empty or not what either tokenizer's bytes spell.  One
    pass, no shuffle.
    """
    a, b = default_paths()
    found = id_and_text(docs).mapInArrow(partial(_groups, path_a=path_a or a, path_b=path_b or b), "doc_id long, groups string")
    sides = F.transform(F.split("groups", ";"), lambda g: F.struct(*(F.split(F.split_part(g, F.lit("|"), F.lit(i)), ",").cast("array<int>").alias(s) for i, s in ((1, "a"), (2, "b")))))
    return found.select("doc_id", sides.alias("groups"))


def link_counts(aligned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Links in order, and how often each occurs in the corpus.

    Of the bytes of two ids that end together one ends with the other, so there are at
    most ``Pair.pairs()`` of them (0.33 million for the two public vocabularies), however large the corpus is.
    """
    table = aligned.select("links").mapInArrow(_count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")).toArrow()
    keys, n = (table.column(c).to_numpy() for c in ("link", "n"))
    order = np.argsort(keys)
    return keys[order].astype("<u4"), n[order]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Groups and links of two tokenizers' tokens over every whole text.

    A is a byte-level vocabulary and sees a space before the text; B is a vocabulary of pieces
    that adds the space.  Byte offsets at which tokens of both end cut the text into
    groups; the last tokens before such an offset are linked.  A first pass aligns the
    documents and keeps their links, four bytes each; the second sums them up, corpus-wide;
    the third looks each document's links up in the sums.  The sums are bounded by the vocabularies
    (``link_counts``).  No text is shuffled.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest
    of their B id, ties included), count_sum, and the SHA-256 of the groups as text.
    Null and empty texts, and those that either tokenizer does not give back byte by
    byte, have zeros and an empty digest.  Repeated rows and null identifiers give a row each and count
    each; an empty table gives no rows; further columns are ignored.
    """
    a, b = default_paths()
    path_a, path_b = path_a or a, path_b or b
    aligned = keep(id_and_text(docs).mapInArrow(partial(_align, path_a=path_a, path_b=path_b), ALIGNED), "aligned")
    keys, counts = link_counts(aligned)
    width = len(pair_of(path_a, path_b).b_bytes)
    most = np.zeros(width, np.int64)
    np.maximum.at(most, keys % width, counts)
    return aligned.mapInArrow(
        partial(_weigh, keys=keys, counts=counts, best=counts == most[keys % width]),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
