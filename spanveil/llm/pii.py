"""Personal data by weak supervision.

Candidate spans (the fixed base patterns and wider ones) get votes of regex,
gazetteer and context labelers. Expectation-maximisation over the counts of the
vote patterns of *all* candidates (a table bounded by the number of patterns)
estimates each labeler's reliability for each kind; the posteriors then train a
logistic span classifier on vote and shape features, which decides on the wider
candidates. Base spans always stay.

Edge cases: spans that start together go by kind as listed; a probability equal to
the threshold takes a span; a null text counts as empty and has no spans; equal rows get equal
results; empty tables give an empty result; offsets are code points; a document
of any length is scanned whole, in time linear in its length; further columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans that start together are listed.
KINDS = (*BASE_KINDS, "secret", "ssn", "iban", "name")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Wider candidates; each is linear in the text.
_WIDE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("card", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{8,}+|eyJ[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{4,}+)(?![0-9A-Za-z])")),
    ("name", re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Dear|[Nn]ame(?:[:=]| is)) ?\.? ?([A-Z][a-z]++(?: [A-Z][a-z]++)*+)(?![A-Za-z])")),
)
_HINT = {"email": ("at)", "at]"), "name": ("Mr", "Ms", "Dr", "Dear", "ame:", "ame=", "ame is")}
#: Words in capitals in a row; a name where the first is a given name.
_CAPITALS = re.compile(r"(?<![A-Za-z])[A-Z][a-z]++(?: [A-Z][a-z]++)++(?![A-Za-z])")

#: Words that speak for a kind when they stand just before a span.
CUES = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "secret": ("token", "secret", "key", "password", "bearer", "auth"),
    "ssn": ("ssn", "social security"),
    "iban": ("iban", "account", "bank"),
    "name": ("name", "dear", "mr", "mrs", "ms", "dr"),
}
_CUE = {k: re.compile("(?:" + "|".join(v) + ")", re.I) for k, v in CUES.items()}
#: Known beginnings or endings by kind.
GAZETTEER = {
    "email": (".com", ".org", ".net", ".edu", ".gov", ".io", ".de", ".fr", ".es", ".uk"),
    "ip": ("10.", "127.", "172.", "192.168."),
    "card": ("4", "5", "34", "37", "6011", "65"),
    "phone": ("+1", "+33", "+34", "+44", "+49", "(800", "(555"),
    "secret": ("AKIA", "sk-", "eyJ", "ghp_"),
    "ssn": (),
    "iban": ("DE", "FR", "ES", "GB", "IT", "NL", "CH", "AT", "BE"),
    "name": tuple(
        """James Mary John Anna Robert Linda Maria David Alice Peter Paul Laura Hans Jean Carlos Sarah Thomas Julia William Patricia Michael Jennifer Richard Elizabeth Joseph Susan Charles Jessica Christopher
        Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Steven Ashley Andrew Emily Kenneth Donna George Michelle Joshua Carol Kevin Amanda Brian Melissa Edward Deborah Ronald Stephanie Timothy
        Rebecca Jason Jeffrey Ryan Jacob Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Frank Gregory Klaus Ursula Helga Wolfgang Sabine Stefan Petra Andreas Monika Claudia Martin
        Sophie Pierre Marie Michel Isabelle Philippe Nathalie Nicolas Sylvie Antoine Camille Luc Jose Carmen Juan Isabel Luis Ana Miguel Pilar Javier Lucia Pedro Elena Diego Rosa Bob Jane Kim Ann""".split()
    ),
}
_GIVEN = frozenset(GAZETTEER["name"])
VOTERS = ("pattern", "checksum", "gazetteer", "context", "boundary", "shape")


def luhn(digits: str) -> bool:
    """Whether a string of ASCII digits passes the Luhn check."""
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base spans by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        i = at
        while i > last and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN.match(text, at + 1) if i < at else None
        if m:
            out.append((i, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    out.sort(key=lambda s: (s[0], _RANK[s[2]]))
    return out


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _checksum(kind: str, s: str) -> int:
    if kind == "card":
        return 1 if luhn(_digits(s)) else -1
    if kind == "ssn":
        return 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    if kind == "iban":
        return 1 if _iban(s) else -1
    return 0


def _shape(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "email":
        return 1 if "." in s.split("@")[-1] or "dot" in s else -1
    if kind == "phone":
        return 1 if 10 <= len(d) <= 15 and len(set(d)) > 2 else -1
    if kind in ("card", "ssn", "ip"):
        return 1 if len(set(d)) > 1 else -1
    if kind == "secret":
        return 1 if len(set(s)) >= 8 else -1
    if kind == "name":
        return 1 if " " in s else 0
    return 1


def votes(text: str, start: int, end: int, kind: str, base: bool) -> tuple[int, ...]:
    """The labelers' votes on one span: 1 for, -1 against, 0 silent."""
    s = text[start:end]
    before = text[max(0, start - 40) : start]
    gaz = GAZETTEER[kind]
    known = any(s.endswith(g) if kind == "email" else s.startswith(g) for g in gaz)
    edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return (
        1 if base else 0,
        _checksum(kind, s),
        1 if known else 0,
        1 if _CUE[kind].search(before) else 0,
        1 if edge else -1,
        _shape(kind, s),
    )


def _wide(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Places of the wider candidates by kind, each kind's in order."""
    digits = bool(_DIGIT.search(text))
    for kind, pattern in _WIDE:
        hint = _HINT.get(kind)
        if any(h in text for h in hint) if hint else digits or kind == "secret":
            yield kind, [m.span(1) if m.lastindex else m.span() for m in pattern.finditer(text)]
    yield "name", [m.span() for m in _CAPITALS.finditer(text) if m[0][: m[0].index(" ")] in _GIVEN]


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """Base spans, and the wider ones that no earlier span overlaps: a sweep along both for each kind."""
    spans = [(a, b, k, True) for a, b, k in base_spans(text)]
    for kind, found in _wide(text):
        if not found:
            continue
        taken = sorted((x[0], x[1]) for x in spans)
        i, reach = 0, 0  # reach: the furthest end of what begins before a candidate
        for a, b in found:
            while i < len(taken) and taken[i][0] <= a:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= a and (i == len(taken) or taken[i][0] >= b):
                spans.append((a, b, kind, False))
    spans.sort(key=lambda s: (s[0], _RANK[s[2]], s[1]))
    return spans


_ROW = "doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, cands array<struct<start:int,end:int,kind:string,base:boolean,pattern:string>>"
_CAND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("pattern", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 1000):
            b = whole.slice(at, 1000)
            counts = {k: np.zeros(len(b), np.int64) for k in BASE_KINDS}
            digest, cands = [], []
            for r, value in enumerate(b.column(1)):
                text = value.as_py() or ""
                spans = candidates(text)
                found = [f"{k}:{s}:{e}" for s, e, k, own in spans if own]
                for s in spans:
                    if s[3]:
                        counts[s[2]][r] += 1
                digest.append(hashlib.sha256(",".join(found).encode()).hexdigest())
                cands.append([{"start": s, "end": e, "kind": k, "base": own, "pattern": k + "|" + ",".join(map(str, votes(text, s, e, k, own)))} for s, e, k, own in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[k]) for k in BASE_KINDS), pa.array(digest, pa.string()), pa.array(cands, _CAND)],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "cands"],
            )


def scan(docs: DataFrame) -> DataFrame:
    """Base figures and voted candidates of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan, _ROW.format(kind=kind))


def em(patterns: dict[tuple[int, ...], int], rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (patterns x labelers), counts and posteriors of one kind; labelers are independent given the truth."""
    v = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[tuple(x)] for x in v], np.float64)
    post = np.clip(0.5 + 0.25 * v.sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.02, 0.98)
        like = np.stack([np.full(len(n), np.log(prior)), np.full(len(n), np.log(1 - prior))])
        for j in range(v.shape[1]):
            for t, w in enumerate((n * post, n * (1 - post))):
                # a beta prior keeps each labeler better than chance, so the classes can't swap
                share = np.array([(w * (v[:, j] == x)).sum() for x in (-1, 0, 1)]) + ([1, 4, 5] if t == 0 else [5, 4, 1])
                like[t] += np.log(share / share.sum())[v[:, j] + 1]
        new = 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return v, n, post


def _classifier(patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Logistic regression on the votes and their pairs, fitted to the posteriors by count."""
    v, n, post = em(patterns)
    pairs = [v[:, i] * v[:, j] for i in range(v.shape[1]) for j in range(i)]
    x = np.column_stack([np.ones(len(v)), v, v == 0, *pairs]).astype(float)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - post)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {tuple(map(int, a)): float(b) for a, b in zip(v, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True)}


def train(found: DataFrame) -> dict[str, float]:
    """The probability of each vote pattern (kind|votes), from the counts of all candidates; at most kinds * 3**labelers rows reach the driver."""
    rows = found.select(F.explode("cands.pattern").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    by: dict[str, dict[tuple[int, ...], int]] = {}
    for r in rows:
        kind, _, v = r["p"].partition("|")
        by.setdefault(kind, {})[tuple(map(int, v.split(",")))] = r["n"]
    return {f"{k}|{','.join(map(str, v))}": p for k, pats in by.items() for v, p in _classifier(pats).items()}


def decide(found: DataFrame, model: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Keeps base spans and the candidates that the classifier takes; spans: array of structs by start, then kind."""
    take = [k for k, p in model.items() if p >= threshold]
    ok = F.array(*[F.lit(k) for k in sorted(take)]) if take else F.array().cast("array<string>")
    return found.withColumn("spans", F.filter("cands", lambda c: c["base"] | F.array_contains(ok, c["pattern"]))).drop("cands")


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: base figures, and spans (start, end, kind, base, pattern)."""
    found = checkpoint(scan(docs))  # the texts are read once; only spans are kept
    return decide(found, train(found), threshold)
