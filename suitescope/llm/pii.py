"""Personal data by candidate gradient boosting.

Base spans come from the contract's four patterns, each leftmost and non-overlapping, with
their checks; they are always in the result.  Beyond them, high-recall generators propose
overlapping spans (numbers without a country code, spelled-out addresses, long tokens, bank
and social-security numbers).  Boosted trees score each proposal by its format (digits,
letters, entropy, checksums, groups) and its context (words before it, quotes, assignment,
neighbouring characters); the trees are trained here, on examples made by a seeded rule, and
calibrated on examples held out from that.  A kind's threshold is the smallest calibrated
probability that keeps the precision asked for on those.  Proposals that overlap a base span
or a better proposal are dropped; among equally probable ones the first, then the shorter, stays.

Offsets are code points with an exclusive end.  Null text is empty text: no spans.  Patterns
are applied to whole texts, and spans of any length are proposed, in time linear in a text's length.
Repeated rows are each scanned.  An empty table gives an empty one.  Other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from ._common import documents, map_arrow, small_batches, table, text_chunks

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_spelled", "phone_local", "ssn", "iban", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

# The contract's patterns.  A lookbehind only stops starts in the middle of a run
# of digits, where no leftmost match can begin, so that long runs take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Each match holds one @ with its local part right before it, so go from @ to @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        done = end
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by kind as listed, then start."""
    out = emails(text)
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return out


# Generators: wide nets, each linear because runs are possessive and begin only where no run goes on;
# a span may come from several.
NETS = (
    ("email_spelled", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[] ?dot ?[)\]]|\.) ?[A-Za-z0-9-]{2,}+)++", re.I), ("(at", "[at", "( at", "[ at", "(AT", "[AT", "(At", "[At")),
    ("phone_local", re.compile(r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"), ()),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), ("-",)),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), ()),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}"), ()),
)
BEFORE = 40
# Words that speak for a kind when they stand shortly before a span.
CUES = (
    ("key", "secret", "token", "passw", "pwd", "auth", "credential", "bearer"),
    ("phone", "tel", "call", "mobile", "fax", "contact", "whatsapp"),
    ("ssn", "social security", "iban", "account", "bank"),
    ("commit", "sha", "md5", "hash", "checksum", "version", "isbn", "order", "invoice", "issue", "digest", "revision"),
)


def candidates(text: str) -> list[Span]:
    out = []
    for kind, net, hints in NETS:
        if not hints or any(h in text for h in hints):
            out += [(kind, m.start(), m.end()) for m in net.finditer(text)]
    return out


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    body, n = text[start:end], end - start
    before, after = text[max(0, start - BEFORE) : start], text[end : end + 1]
    low = before.lower()
    count = {c: body.count(c) for c in set(body)}
    digits = sum(v for c, v in count.items() if "0" <= c <= "9")
    upper = sum(v for c, v in count.items() if "A" <= c <= "Z")
    lower = sum(v for c, v in count.items() if "a" <= c <= "z")
    tail = before.rstrip()
    return [
        *(float(kind == k) for k in ADDED_KINDS),
        n, digits / n, upper / n, lower / n, sum(count.get(c, 0) for c in " ().-") / n,
        -sum(v / n * math.log2(v / n) for v in count.values()),
        float(all(c in "0123456789abcdef" for c in count) or all(c in "0123456789ABCDEF" for c in count)),
        len(re.findall(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])", body)) / n,
        float(kind == "iban" and iban_ok(body)), float(luhn(digits_of(body)) if digits >= 12 else 0),
        *(float(any(c in low for c in cues)) for cues in CUES),
        float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in "\"'`" and before != ""),
        float(tail.rstrip("\"'`").rstrip()[-1:] in "=:" and tail != ""), float(before[-1:] in "/#@." and before != ""),
    ]


def _examples(rng: random.Random) -> list[tuple[str, Span, int]]:
    """(text, span, is personal) from templates; what the nets find in each is labelled by where it was put."""
    pick, alnum, hexa = rng.choice, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    some = lambda chars, n: "".join(pick(chars) for _ in range(n))
    num = lambda n: some("0123456789", n)
    word = lambda: some("abcdefghilmnoprstuv", rng.randint(2, 9))

    def iban() -> str:
        country, rest = pick(["DE", "FR", "ES", "GB"]), num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        return f"{country}{check:02d}{rest}"

    tokens = lambda: pick([some(hexa, 40), some(hexa, 32), some(hexa.upper(), 40), some(alnum, rng.randint(24, 48)), "ghp_" + some(alnum, 36), "AKIA" + some(alnum[:26] + "0123456789", 16), some(alnum + "+/", 40)])
    good = (
        lambda: (f'{pick(["api_key", "secret", "token", "password", "auth_token", "access_key", "client_secret", "API_KEY", "SECRET"])} {pick(["=", ":", "= "])} {(q := pick(["", chr(34), chr(39)]))}', tokens(), q),
        lambda: (pick(["call ", "phone: ", "tel. ", "Tel ", "mobile ", "my phone is ", "contact us at "]), pick([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(4)}"]), ""),
        lambda: (pick(["ssn ", "SSN: ", "social security number ", "social security no. "]), f"{num(3)}-{num(2)}-{num(4)}", ""),
        lambda: (pick(["iban ", "IBAN: ", "account ", "transfer to ", ""]), iban(), ""),
        lambda: (pick(["write to ", "mail ", ""]), f"{word()}.{word()} (at) {word()} (dot) {pick(['com', 'org', 'net'])}", ""),
    )
    bad = (
        lambda: (pick(["commit ", "sha1: ", "checksum ", "md5 = ", "revision ", "digest: "]), some(hexa, pick([32, 40, 64])), ""),
        lambda: (pick(["", "see ", "in ", "the ", "https://x.org/"]), "-".join(word() for _ in range(rng.randint(4, 8))), ""),
        lambda: (pick(["", "x ", "field "]), "_".join(word() for _ in range(rng.randint(4, 8))), ""),
        lambda: ("", some("abcdefghilmnoprstuv", rng.randint(20, 60)), ""),
        lambda: ("", some("ABCDEFGHILMNOPRSTUV", rng.randint(20, 60)), ""),
        lambda: ("", pick("-=_+/") * rng.randint(20, 80), ""),
        lambda: (pick(["order ", "invoice ", "version ", "in ", "from ", "", "pages "]), pick([f"{num(3)}-{num(3)}-{num(4)}", f"{num(4)}-{num(2)}-{num(4)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(3)} {num(3)} {num(3)}"]), ""),
        lambda: (pick(["isbn ", "issue ", "order ", "ref "]), f"{num(3)}-{num(2)}-{num(4)}", ""),
        lambda: (pick(["", "order ", "in ", "the ", "number "]), num(rng.randint(20, 40)), ""),
        lambda: ("", f"{pick(['DE', 'AB', 'XX', 'IN'])}{num(18)}", ""),
        lambda: ("", "/".join(word() for _ in range(6)), ""),
        lambda: (pick(["look ", "meet "]), f"{word()} (at) {word()}.{word()}", ""),
    )
    out = []
    for make, label in [(m, 1) for m in good] * 60 + [(m, 0) for m in bad] * 50:
        lead, body, close = make()
        left = " ".join(word() for _ in range(rng.randint(0, 6)))
        text = f"{left} {lead}{body}{close}{pick(['', '.', ',', '###', ' &&&'])} " + " ".join(word() for _ in range(rng.randint(0, 6)))
        at = len(left) + 1 + len(lead)
        out += [(text, s, label) for s in candidates(text) if s[1] < at + len(body) and s[2] > at]
    return out


@dataclass
class Model:
    trees: boosting.Trees
    slope: float
    shift: float
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return boosting.sigmoid(self.slope * self.trees.raw(x) + self.shift)


@functools.lru_cache(maxsize=4)
def train(seed: int = 17, precision: float = 0.98) -> Model:
    """Trees from made examples, calibrated on others; runs on the driver in about a second."""
    parts = []
    for part in (seed, seed + 1):
        found = _examples(random.Random(part))
        parts.append((np.array([features(t, s) for t, s, _ in found]), np.array([y for *_, y in found], float), [s[0] for _, s, _ in found]))
    (x, y, _), (cx, cy, kinds) = parts
    trees = boosting.fit(x, y)
    raw = trees.raw(cx)
    slope, shift = boosting.platt(raw, cy)
    p, thresholds = boosting.sigmoid(slope * raw + shift), {}
    for k in ADDED_KINDS:
        own = np.array([kind == k for kind in kinds])
        order = np.argsort(-p[own], kind="stable")
        good = np.cumsum(cy[own][order]) / (np.arange(own.sum()) + 1) >= precision
        thresholds[k] = max(0.5, float(p[own][order][np.flatnonzero(good)[-1]])) if good.any() else 1.1
    return Model(trees, slope, shift, thresholds)


class Covered:
    """Stretches that don't overlap, in order; each is found by bisection."""

    def __init__(self, spans: list[Span]):
        self.start: list[int] = []
        self.end: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.end and start < self.end[-1]:
                self.end[-1] = max(self.end[-1], end)
            else:
                self.start.append(start), self.end.append(end)

    def add(self, start: int, end: int) -> bool:
        """Whether the stretch overlapped none; then it is one of them."""
        at = bisect.bisect_right(self.end, start)
        if at < len(self.start) and self.start[at] < end:
            return False
        self.start.insert(at, start), self.end.insert(at, end)
        return True


def find_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; all spans by kind as in KINDS, then start."""
    base = [base_spans(t) for t in texts]
    proposed = [(i, s) for i, t in enumerate(texts) for s in candidates(t)]
    added: list[list[Span]] = [[] for _ in texts]
    if proposed:
        p = model.probability(np.array([features(texts[i], s) for i, s in proposed]))
        kept = sorted((i, -p[k], s) for k, (i, s) in enumerate(proposed) if p[k] >= model.thresholds[s[0]])
        for i, group in itertools.groupby(kept, key=lambda x: x[0]):
            taken = Covered(base[i])
            added[i] = [s for _, _, s in group if taken.add(s[1], s[2])]
    rank = {k: n for n, k in enumerate(KINDS)}
    return [(b, sorted(b + a, key=lambda s: (rank[s[0]], s[1]))) for b, a in zip(base, added, strict=True)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans): spans as arrays of (kind, begin, end)."""
    docs, model = documents(df, id_column, text_column), model or train()
    span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
    shape = lambda spans: [{"kind": k, "begin": s, "end": e} for k, s, e in spans]

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = find_spans([t or "" for t in batch.column(1).to_pylist()], model)
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([shape(b) for b, _ in found], span), pa.array([shape(a) for _, a in found], span)], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_spans", "spans"])

    kind = "array<struct<kind:string,begin:bigint,end:bigint>>"
    return map_arrow(docs, find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_spans {kind}, spans {kind}")


def redact_text(text: str, spans: list[Span]) -> str:
    """Each stretch covered by spans gives way to the kind of the span that begins it, in brackets."""
    out, done, covered = [], 0, 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= covered:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = covered = max(covered, end)
    return "".join(out) + text[done:]


def redact(df: DataFrame, text_column: str = "text", model: Model | None = None) -> DataFrame:
    """``df`` with personal data replaced in its text; texts without any stay as they are, null too."""
    model = model or train()

    @F.pandas_udf("string")
    def clean(texts):
        found = [f for part in text_chunks(texts) for f in find_spans(part.to_pylist(), model)]
        return texts.__class__([redact_text(t, s) if s else (t if isinstance(t, str) else None) for t, (_, s) in zip(texts, found, strict=True)], dtype=object)

    small_batches(df.sparkSession)
    return df.withColumn(text_column, clean(F.col(text_column)))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))
