"""Personal data by weak supervision: labelers vote, EM weighs them, a trained classifier decides.

Base spans are found by exact rules (leftmost, non-overlapping per kind; an e-mail address, an IPv4-like
number, a card number passing Luhn, a phone number with country code) and always stay.
Further candidates are looser forms of the same kinds: spelled-out addresses ("name at host dot org", "name [at] host.org"), IPv6
addresses, dotted quads with parts above 255, card-like digit groups that fail Luhn or stand between other marks, phone numbers
without country code or with 00 for it. Three labelers vote on every candidate, each yes, no or silent:
the strict rule (regex: yes where it holds, no where its form is there but a part fails, silent on other forms),
lists of known endings, networks, issuers and area forms (gazetteer), and the words before the candidate (context). Votes of all candidates of all documents are counted per kind
and pattern in Spark; expectation-maximisation over these few counts estimates how reliable each labeler is and
how likely each pattern is personal data. A logistic classifier over the span's features is trained on
those likelihoods, again on counts per feature pattern. A further candidate becomes a span if the classifier
gives it more than CUT and it overlaps no base span of its kind.

Null texts are empty and have no spans. Positions are code points of the whole text; long texts take time linear in their length
and spans. Rows are judged one by one: repeats agree; null doc_ids too. report() ignores other columns, redact() keeps them. Without candidates nothing is trained and nothing added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
CUT, EM_ROUNDS, FIT_ROUNDS, PRIOR, DOUBT = 0.9, 50, 300, 2.0, 0.05
YES, NO, SILENT = 1, 0, 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit run is only entered at its start: from within it, the rest would match or fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![\w.+-])[A-Za-z0-9._+-]{1,64} ?[\[(]? ?(?:at|AT) ?[\])]? ?[A-Za-z0-9-]{1,63} ?[\[(]? ?(?:dot|DOT) ?[\])]? ?[A-Za-z]{2,12}(?!\w)")
_MARKED_AT = re.compile(r"(?<![\w.+-])[A-Za-z0-9._+-]{1,64} ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}(?![\w])")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_MARKED_CARD = re.compile(r"(?<![\w./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\w./_])")
_ABROAD = re.compile(r"(?<![\w+.-])00[1-9](?:[\x20().-]?[0-9]){7,13}(?![\w-])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")

#: Endings of hosts, first digits of card issuers.
_ENDINGS = frozenset("com org net edu gov mil int info biz io eu de fr es uk ch at it nl us ca au jp".split())
_ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65")
#: Words whose presence before a candidate speaks for its kind, and words that speak against any.
_FOR = {
    "email": frozenset("mail email e-mail mailto contact write address reach inbox correo courriel adresse".split()),
    "ip": frozenset("ip ips address host hosts server addr client node gateway dns subnet login from peer".split()),
    "card": frozenset("card cards visa mastercard amex credit debit payment pay account tarjeta carte karte".split()),
    "phone": frozenset("phone call calls tel telephone mobile fax cell dial number hotline whatsapp sms telefon teléfono téléphone".split()),
}
_AGAINST = frozenset("version versions release build isbn issn doi order invoice serial id no figure section chapter v page ref item part model sku".split())
#: Characters before a candidate that are looked at, and words of them.
_REACH, _WORDS = 80, 8
_WORD = re.compile(r"[^\W\d_](?:[\w-]*[^\W\d_])?")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match holds one @; it starts with all local characters in front of that, back to the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def _strict(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, vote of the rule) of every match of the four patterns."""
    verdict = lambda good: YES if good else NO
    out = [(0, a, b, YES) for a, b in _emails(text)]
    out += [(1, m.start(), m.end(), verdict(all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 13 <= len(d) <= 19:
            out.append((2, m.start(), m.end(), verdict(_luhn(d))))
    out += [(3, m.start(), m.end(), YES) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted((k, a, b) for k, a, b, vote in _strict(text) if vote == YES)


def _loose(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, SILENT) of other forms; the cheap tests in front spare most texts the patterns."""
    out = []
    if "dot" in text or "DOT" in text:
        out += [(0, m.start(), m.end(), SILENT) for m in _SPELLED.finditer(text)]
    if any(x in text for x in ("at]", "at)", "at}", "at ]", "at )", "AT]", "AT)", "@]", "@)")):
        out += [(0, m.start(), m.end(), SILENT) for m in _MARKED_AT.finditer(text)]
    if text.count(":") >= 7:
        out += [(1, m.start(), m.end(), SILENT) for m in _IP6.finditer(text)]
    out += [(2, m.start(), m.end(), SILENT if _luhn(_digits(m[0])) else NO) for m in _MARKED_CARD.finditer(text)]
    if "00" in text:
        out += [(3, m.start(), m.end(), SILENT) for m in _ABROAD.finditer(text)]
    return out + [(3, m.start(), m.end(), SILENT) for m in _LOCAL_PHONE.finditer(text)]


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, votes, features): base spans have bit 0 of features set."""
    found = _strict(text)
    base = sorted((k, a, b) for k, a, b, vote in found if vote == YES)  # of one kind they don't overlap
    starts = [x[:2] for x in base]

    def free(k: int, a: int, b: int) -> bool:
        last = bisect_left(starts, (k, b)) - 1
        return last < 0 or base[last][0] != k or base[last][2] <= a

    found = [x for x in found + _loose(text) if x[3] == YES or free(*x[:3])]
    return [(k, a, b, *_votes(text, k, a, b, vote)) for k, a, b, vote in sorted(set(found))]


def _gazetteer(kind: int, span: str) -> int:
    d = _digits(span)
    if kind == 0:
        return YES if re.split(r"[.\s\])]", span)[-1].lower() in _ENDINGS else SILENT
    if kind == 1 and ":" in span:
        return YES if span[:4].lower() in ("fe80", "2001", "2a00", "2600", "2a02") or span[:2].lower() in ("fc", "fd") else SILENT
    if kind == 1:
        return NO if d.startswith("0") or any(len(p) > 3 for p in span.split(".")) else YES
    if kind == 2:
        return YES if d.startswith(_ISSUERS) and len(d) in (14, 15, 16) else NO
    return NO if len(set(d)) < 3 else YES if 10 <= len(d) <= 13 else SILENT


def _votes(text: str, kind: int, a: int, b: int, rule: int) -> tuple[int, int]:
    before = _WORD.findall(text[max(0, a - _REACH) : a].lower())[-_WORDS:]
    context = NO if _AGAINST & set(before[-2:]) else YES if _FOR[KINDS[kind]] & set(before) else SILENT
    gazetteer = _gazetteer(kind, text[a:b])
    apart = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    votes = rule + 3 * gazetteer + 9 * context
    return votes, (rule == YES) + 64 * (rule == NO) + 2 * (gazetteer == YES) + 4 * (gazetteer == NO) + 8 * (context == YES) + 16 * (context == NO) + 32 * apart


_FEATURES = 7


class Model:
    """Reliability of the labelers, and weights of the classifier per kind."""

    def __init__(self, reliability: dict[int, list[float]], weights: dict[int, np.ndarray]):
        self.reliability, self.weights = reliability, weights

    def probability(self, kind: int, features: int) -> float:
        if kind not in self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-(self.weights[kind] @ _vector(features)))))


def _vector(features: int) -> np.ndarray:
    return np.array([1.0] + [float(features >> i & 1) for i in range(_FEATURES)])


def expectation_maximisation(counts: dict[int, float]) -> tuple[list[float], dict[int, float]]:
    """(reliability of each labeler, likelihood of each vote pattern) from counts of patterns.

    Reliability is how often a labeler that speaks is right. PRIOR right votes in PRIOR + 1 keep it from running off."""
    votes = np.array([[p // 3**i % 3 for i in range(3)] for p in counts])
    n = np.array(list(counts.values()), float)
    right, share = np.array([0.9, 0.7, 0.7]), 0.5
    for _ in range(EM_ROUNDS):
        like = lambda yes: np.prod(np.where(votes == SILENT, 1.0, np.where(votes == (YES if yes else NO), right, 1 - right)), axis=1)
        p = share * like(True) / (share * like(True) + (1 - share) * like(False))
        agree = np.where(votes == YES, p[:, None], 1 - p[:, None]) * (votes != SILENT) * n[:, None]
        right = np.clip((agree.sum(0) + PRIOR) / (((votes != SILENT) * n[:, None]).sum(0) + PRIOR + 1), 0.05, 0.99)
        share = float(np.clip((p * n).sum() / n.sum(), 0.01, 0.99))
    return right.tolist(), dict(zip(counts, p.tolist(), strict=True))


def fit(counts: list[tuple[int, int, int, int]]) -> Model:
    """counts: (kind, votes, features, how many), over all documents."""
    reliability, weights = {}, {}
    for kind in sorted({k for k, *_ in counts}):
        own = [x[1:] for x in counts if x[0] == kind]
        patterns: dict[int, float] = {}
        for v, _, n in own:
            patterns[v] = patterns.get(v, 0) + n
        reliability[kind], likely = expectation_maximisation(patterns)
        # Nothing known is no reason to call it personal data: PRIOR such candidates each. Nor are words that speak against it: each weighs as much as DOUBT of all.
        doubtful = (0, 4, 16, 18, 32, 36, 48, 50, 64, 68, 80, 96, 100, 112)
        x = np.array([_vector(f) for _, f, _ in own] + [_vector(f) for f in doubtful])
        y = np.array([likely[v] for v, _, _ in own] + [0.0] * len(doubtful))
        n = np.array([c for *_, c in own] + [max(PRIOR, DOUBT * sum(patterns.values())) if f & 16 else PRIOR for f in doubtful], float)
        n /= n.sum()
        w = np.zeros(x.shape[1])
        for _ in range(FIT_ROUNDS):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (p - y)) + 1e-4 * w
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), gradient)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        weights[kind] = w
    return Model(reliability, weights)


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, votes, features and how many candidates of all documents have them (a few hundred rows at most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, int, int], int] = {}
            for t in batch.column(0):
                for k, _, _, v, f in candidates(t.as_py() or ""):
                    counts[k, v, f] = counts.get((k, v, f), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in counts], pa.int32()) for i in range(3)] + [pa.array(list(counts.values()), pa.int64())], names=["kind", "votes", "features", "n"])

    counted = docs.select(text).mapInArrow(run, "kind int, votes int, features int, n long")
    return counted.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text") -> Model:
    return fit(sorted(tuple(r) for r in vote_counts(docs, text).collect()))


def all_spans(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by kind and start; added spans overlap no other of their kind."""
    base, added = [], []
    for k, a, b, _, f in candidates(text):
        if f & 1:
            base.append((k, a, b))
        elif model.probability(k, f) > CUT and not (added and added[-1][0] == k and added[-1][2] > a):
            added.append((k, a, b))
    return base, sorted(base + added)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: base counts, digest of the base spans, and all spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t.as_py() or "", model) for t in batch.column(1)]
            counts = [pa.array([sum(x[0] == k for x in base) for base, _ in found], pa.int64()) for k in range(4)]
            digests = [hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_written(every) for _, every in found], pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans of two kinds become one. Null texts stay null."""
    names = docs.columns
    at = names.index(text)

    def clean(t: str) -> str:
        # Taking one span away can complete another (digits that ran on into it), so again until there is none.
        while spans := sorted((a, b, k) for k, a, b in all_spans(t, model)[1]):
            out, end = [], 0
            for a, b, k in spans:
                if a >= end:
                    out += [t[end:a], f"[{KINDS[k]}]"]
                end = max(end, b)
            t = "".join(out) + t[end:]
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if not t.is_valid else clean(t.as_py()) for t in batch.column(at)], batch.schema.types[at])
            yield batch.set_column(at, batch.schema.field(at), new)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def run(docs: DataFrame) -> DataFrame:
    return report(docs, train(docs))
