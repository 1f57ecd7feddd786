"""Operator 4, personal data by weak supervision.

Candidates are spans of fixed shapes: the four base kinds of the contract, shapes that nearly are one of them, national
numbers, secrets and names. Labelers vote 1 (personal), 0 (not) or abstain on each; they look at different things (form,
validity, gazetteers, words before, words after, neighbouring characters, variety, company of other spans), each with
errors of its own. One pass over the texts writes the candidates of each row with their votes and features.

Expectation-maximisation over the counts of all distinct (kind, votes), of which there are at most kinds times 3^labelers
whatever the input, estimates each labeler's sensitivity and specificity by kind, shrunk towards its mean over kinds, and
each kind's rate. The final span classifier, a logistic regression on hashed features of the span's own characters and its
surroundings (not the votes), is trained on the posteriors of a bounded sample: about MAX_FIT candidates a kind, by a hash of
text and place. It is applied to the written candidates: base spans always stay; others are added where it gives THRESHOLD
or more; these overlap no base span.

Defined cases: a null text is the empty text; texts of any length are scanned in linear time and without windows;
candidates that overlap are taken in the order of KINDS, then from the left; rows repeat as they are; other columns are
ignored; an empty table gives an empty result and a model that adds nothing.
"""

from __future__ import annotations

import math
import re
import zlib

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.shared import bounded_batches, documents
from trawl.scratch import materialise

BASE = ("email", "ip", "card", "phone")
#: All kinds of spans, base first; `near_` candidates are spans that fail a base rule.
KINDS = (*BASE, "near_card", "near_phone", "national_id", "secret", "name")
THRESHOLD = 0.5
EM_ROUNDS = 60
#: Candidates a kind from which the classifier is fitted, and bits of its feature hash.
MAX_FIT = 2000
FEATURE_BITS = 14
#: Spans that the prior of a reliability counts as, and reliabilities (sensitivity, specificity) that are known.
PRIOR = 10.0
FIXED = {(kind, 1): (0.98, 0.9) for kind in ("card", "near_card")}
#: Characters on either side of a span that labelers and features look at.
REACH = 40
#: Characters within which another span is company.
NEIGHBOURHOOD = 200

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i:\b(?:token|password|passwd|secret|api[_-]?key))[ ]?[:=][ ]?[\"']?([A-Za-z0-9_/+-]{6,})")
_THREE = re.compile(r"[0-9]{3}")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Sr", "Sra", "Mme")
_NAME = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? ([A-Z][a-z]+(?: [A-Z][a-z]+)?)")
_WORD = re.compile(r"[^\W\d_]+")

#: Common given names, last labels of mail domains, country calling codes, and issuers' first digits.
GIVEN_NAMES = frozenset("anna john mary peter paul maria james robert linda david susan hans klaus petra jean pierre marie claire jose carmen luis ana juan laura michael thomas sarah emma lucas marc".split())
DOMAIN_ENDS = frozenset("com org net edu gov info io de fr es eu uk us ch at".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91", "351", "353", "358", "385", "386", "420", "421")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36")
#: Words near a span that speak for its kind, and words near a number that speak against any.
_CONTEXT = {
    "email": "email e-mail mail contact write correo courriel",
    "ip": "ip host server address from login client",
    "card": "card visa mastercard credit payment karte carte tarjeta",
    "phone": "phone tel call fax mobile contact telefon",
    "near_card": "card visa mastercard credit payment karte carte tarjeta",
    "near_phone": "phone tel call fax mobile telefon",
    "national_id": "ssn social security passport",
    "secret": "token password secret key api login",
    "name": "name dear contact regards from",
}
CONTEXT = {kind: frozenset(words.split()) for kind, words in _CONTEXT.items()}
AGAINST = frozenset("version order invoice total isbn issn page section figure table line number sum item row example sample dummy".split())
LABELERS = ("form", "validity", "gazetteer", "before", "after", "neighbours", "variety", "company")
MAX_PATTERNS = len(KINDS) * 3 ** len(LABELERS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches. Each @ has one possible local part, the run to its left, and one domain to its right,
    so every character is looked at a bounded number of times."""
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            done = domain.end()
            yield left, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = digits_of(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, other candidates); the latter overlap neither a base span nor each other."""
    base = base_spans(text)
    found: dict[str, list[tuple[int, int]]] = {"near_card": [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(digits_of(m.group())) <= 19]}
    if _THREE.search(text):
        found["near_phone"] = [m.span() for m in _LOCAL_PHONE.finditer(text)]
        found["national_id"] = [m.span() for m in _NATIONAL.finditer(text)]
    if "=" in text or ":" in text:
        found["secret"] = [m.span(1) for m in _SECRET.finditer(text)]
    if any(t + " " in text or t + ". " in text for t in TITLES):
        found["name"] = [m.span(1) for m in _NAME.finditer(text)]
    extra: list[tuple[str, int, int]] = []
    if any(found.values()):
        taken = sorted((a, b) for _, a, b in base)
        for kind in KINDS:
            free, k = [], 0
            for a, b in found.get(kind, ()):
                while k < len(taken) and taken[k][1] <= a:
                    k += 1
                if k == len(taken) or taken[k][0] >= b:
                    free.append((a, b))
            extra += [(kind, *span) for span in free]
            taken = sorted(taken + free)
    return base, extra


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


class Seen:
    """A candidate as labelers and features see it."""

    def __init__(self, text: str, kind: str, start: int, end: int, near: int) -> None:
        self.kind, self.span, self.near = kind, text[start:end], near
        self.digits = digits_of(self.span)
        self.left, self.right = text[max(0, start - REACH) : start], text[end : end + REACH]
        self.before = [w.lower() for w in _WORD.findall(self.left)[-4:]]
        self.after = [w.lower() for w in _WORD.findall(self.right)[:4]]


def seen(text: str, spans: list[tuple[str, int, int]]) -> list[Seen]:
    """Each span with the number of others in its NEIGHBOURHOOD; spans in any order."""
    starts = np.sort(np.array([a for _, a, _ in spans], np.int64))
    low = np.searchsorted(starts, np.array([a - NEIGHBOURHOOD for _, a, _ in spans], np.int64))
    high = np.searchsorted(starts, np.array([b + NEIGHBOURHOOD for _, _, b in spans], np.int64))
    return [Seen(text, *span, int(n) - 1) for span, n in zip(spans, high - low, strict=True)]


def _form(s: Seen) -> int:
    """The strict form of the kind."""
    n = len(s.digits)
    if s.kind == "email":
        local, _, domain = s.span.partition("@")
        return int(local[0].isalnum() and local[-1].isalnum() and ".." not in local and domain.rsplit(".", 1)[-1].isalpha())
    if s.kind == "ip":
        return int(all(len(p) == 1 or p[0] != "0" for p in s.span.split(".")))
    if s.kind in ("card", "near_card"):
        return int(n == 16 and (s.span.isdigit() or [len(g) for g in re.split("[ -]", s.span)] == [4, 4, 4, 4]))
    if s.kind in ("phone", "near_phone"):
        return int(10 <= n <= 13 and s.span.count("(") == s.span.count(")"))
    if s.kind == "secret":
        return int(len(s.span) >= 20)
    return 1 if s.kind == "national_id" or " " in s.span else -1


def _validity(s: Seen) -> int:
    """Checksums, ranges and entropy."""
    if s.kind in ("card", "near_card"):
        return int(luhn(s.digits))
    if s.kind == "ip":
        first, *_, last = (int(p) for p in s.span.split("."))
        return int(0 < first < 224 and 0 < last < 255)
    if s.kind == "national_id":
        return int(not s.digits.startswith(("000", "666", "9")) and s.digits[3:5] != "00" and s.digits[5:] != "0000")
    if s.kind in ("phone", "near_phone"):
        return int(s.digits[-10:-9] not in ("0", "1"))
    if s.kind == "secret":
        return int(entropy(s.span) >= 2.8)
    return -1


def _gazetteer(s: Seen) -> int:
    if s.kind == "email":
        return int(s.span.rsplit(".", 1)[-1].lower() in DOMAIN_ENDS)
    if s.kind == "name":
        return int(s.span.split(" ")[0].lower() in GIVEN_NAMES)
    if s.kind == "phone":
        return int(s.digits.startswith(CALLING_CODES))
    if s.kind in ("card", "near_card"):
        return int(s.digits.startswith(ISSUERS))
    if s.kind == "ip":
        return 0 if s.span.startswith(("10.", "127.", "192.168.", "0.")) else -1
    return -1


def _words(kind: str, words: list[str]) -> int:
    """1 where a word of the kind's context is near, 0 where one is that speaks against numbers."""
    if not CONTEXT[kind].isdisjoint(words):
        return 1
    return 0 if kind not in ("email", "name") and not AGAINST.isdisjoint(words) else -1


def _neighbours(s: Seen) -> int:
    """0 in a table's cell, glued to a longer token or among other numbers; 1 between words; else no vote."""
    before, after = s.left[-1:], s.right[:1]
    glued = before.isalnum() or after.isalnum() or (before and before in "/=._#") or (after and after in "/_%€$")
    table = "|" in s.left[-4:] or "|" in s.right[:4] or "\t" in (before, after)
    if glued or table or len(digits_of(s.left[-12:] + s.right[:12])) >= 6:
        return 0
    return 1 if s.before and s.after else -1


def _variety(s: Seen) -> int:
    """0 for made-up characters: few different ones, a run of consecutive digits, a plain word as a secret."""
    if s.kind == "secret":
        return int(any(c.isdigit() for c in s.span) and any(c.isalpha() for c in s.span) and len(set(s.span)) > 6)
    if s.kind in ("email", "name"):
        return int(len(set(s.span.split("@")[0])) > 1)
    return int(len(set(s.digits)) > 2 and s.digits[:8] not in "01234567890123456789" and s.digits[:8] not in "98765432109876543210")


def votes(s: Seen) -> tuple[int, ...]:
    """What each labeler says: 1 personal, 0 not, -1 abstains."""
    return _form(s), _validity(s), _gazetteer(s), _words(s.kind, s.before), _words(s.kind, s.after), _neighbours(s), _variety(s), 1 if s.near else -1


def _outline(s: str) -> str:
    """The span's characters by class: digits 9, capitals A, small letters a, others as they are; runs as one."""
    out = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s[:64]]
    return "".join(c for k, c in enumerate(out) if not k or out[k - 1] != c)


def span_features(s: Seen) -> list[int]:
    """Hashed features of the span's characters and its surroundings, each together with the kind."""
    names = ["bias", f"outline {_outline(s.span)}", f"length {min(len(s.span), 40) // 3}", f"digits {len(s.digits)}", f"head {s.span[:2]}", f"tail {s.span[-2:]}"]
    names += [f"different {min(12, len(set(s.span)))}", f"luhn {luhn(s.digits) if s.digits else ''}", f"entropy {int(2 * entropy(s.span))}"]
    names += [f"before {w}" for w in s.before[-2:]] + [f"after {w}" for w in s.after[:2]]
    names += [f"left {_outline(s.left[-3:])}", f"right {_outline(s.right[:3])}", f"table {'|' in s.left[-4:] + s.right[:4]}", f"numbers {min(3, len(digits_of(s.left + s.right)) // 4)}", f"near {min(3, s.near)}"]
    return sorted({zlib.crc32(f"{s.kind} {n}".encode()) & ((1 << FEATURE_BITS) - 1) for n in names})


class Model:
    """Logistic span classifier over hashed features."""

    def __init__(self, weights: np.ndarray | None = None) -> None:
        self.weights = weights

    def probability(self, features: list[int]) -> float:
        return 0.0 if self.weights is None else float(1 / (1 + np.exp(-np.clip(self.weights[features].sum(), -40, 40))))


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, float]]:
    """(posterior of each pattern, by kind [sensitivity, specificity] of each labeler, rate of each kind).

    Dawid and Skene's model with a labeler's reliability by kind. The prior of a reliability counts as PRIOR spans with the
    labeler's mean over kinds, which itself begins as if it had been right 8 times of 10; that keeps the two classes from
    changing places and a kind of few spans from being read into. What is known by construction is not estimated: a check
    digit is right in one of ten made-up numbers (FIXED).
    """
    said = np.array([p[1] for p in patterns])
    count = np.array([p[2] for p in patterns], float)
    kinds = sorted({p[0] for p in patterns})
    kind = np.array([kinds.index(p[0]) for p in patterns])
    labelers = said.shape[1]
    trust = np.full((len(kinds), labelers, 2), 0.8)
    rate = np.array([0.9 if k in BASE else 0.3 if k.startswith("near_") else 0.5 for k in kinds])
    yes, no = said == 1, said == 0
    for _ in range(rounds):
        own = trust[kind]
        log = np.stack([np.log(1 - rate[kind]), np.log(rate[kind])])
        log[1] += (yes * np.log(own[:, :, 0]) + no * np.log(1 - own[:, :, 0])).sum(axis=1)
        log[0] += (yes * np.log(1 - own[:, :, 1]) + no * np.log(own[:, :, 1])).sum(axis=1)
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
        right, all_ = np.zeros((len(kinds), labelers, 2)), np.zeros((len(kinds), labelers, 2))
        for side, (hit, share) in enumerate(((yes, posterior), (no, 1 - posterior))):
            np.add.at(right[:, :, side], kind, hit * (count * share)[:, None])
            np.add.at(all_[:, :, side], kind, (yes | no) * (count * share)[:, None])
        # kinds count alike in the mean, as much as PRIOR spans at most
        scale = np.minimum(1, PRIOR / np.maximum(all_, 1e-9))
        mean = ((right * scale).sum(axis=0) + 0.8 * PRIOR) / ((all_ * scale).sum(axis=0) + PRIOR)
        trust = np.clip((right + PRIOR * mean) / (all_ + PRIOR), 0.02, 0.98)
        for (name, j), known in FIXED.items():
            if name in kinds and j < labelers:
                trust[kinds.index(name), j] = known
        for k, name in enumerate(kinds):
            mine = (kind == k) * count
            rate[k] = ((mine * posterior).sum() + (9 if name in BASE else 1)) / (mine.sum() + (10 if name in BASE else 2))
    return posterior, {name: trust[k] for k, name in enumerate(kinds)}, dict(zip(kinds, rate.tolist(), strict=True))




def fit(rows: list[tuple[str, list[int], float]], epochs: int = 25, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """The classifier from (kind, features, posterior), by AdaGrad on the expected log-likelihood; kinds count alike."""
    if not rows:
        return Model()
    many = Counter(r[0] for r in rows)
    sizes = np.array([len(r[1]) for r in rows])
    flat, ends = np.concatenate([r[1] for r in rows]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
    target = np.array([r[2] for r in rows])
    worth = np.array([min(4.0, len(rows) / len(many) / many[r[0]]) for r in rows])
    w, square = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-6)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            part = order[at : at + 64]
            index = np.concatenate([flat[ends[i] : ends[i + 1]] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes[part])
            z = np.bincount(owner, w[index], minlength=len(part))
            error = (target[part] - 1 / (1 + np.exp(-np.clip(z, -40, 40)))) * worth[part]
            step = np.bincount(index, error[owner], minlength=len(w)) - l2 * w
            square += step * step
            w += rate * step / np.sqrt(square)
    return Model(w)


#: A candidate: the span, whether a base rule made it, its votes, a hash of text and place, and its features.
CANDIDATE = "struct<kind: string, start: int, end: int, base: boolean, said: array<tinyint>, place: bigint, features: array<int>>"
_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("said", pa.list_(pa.int8())), ("place", pa.int64()), ("features", pa.list_(pa.int32()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, candidates): base ones by kind as listed, then start, then the others alike."""
    for batch in batches:
        rows = []
        for text in batch.column(1):
            t = text.as_py()
            base, extra = candidates(t)
            found = []
            if base or extra:
                own = zlib.crc32(t.encode())
                for k, ((kind, start, end), s) in enumerate(zip(base + extra, seen(t, base + extra), strict=True)):
                    place = (own << 20 ^ zlib.crc32(f"{kind}{start}".encode())) & ((1 << 32) - 1)
                    found.append({"kind": kind, "start": start, "end": end, "base": k < len(base), "said": votes(s), "place": place, "features": span_features(s)})
            rows.append(found)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_CANDIDATE))], ["doc_id", "candidates"])


def scanned(texts: DataFrame) -> DataFrame:
    """(doc_id, candidates) of each row of texts (doc_id, text)."""
    return texts.select("doc_id", "text").mapInArrow(_scan, f"doc_id long, candidates array<{CANDIDATE}>")


def train(rows: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """EM over the votes on all candidates of rows (as of scanned), then the classifier from about max_fit of each kind."""
    spans = rows.select(F.explode("candidates").alias("c")).select("c.kind", "c.said", "c.place", "c.features")
    counted = spans.groupBy("kind", "said").agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted((r["kind"], tuple(r["said"]), r["n"]) for r in counted.limit(MAX_PATTERNS).collect())
    if not patterns:
        return Model()
    posterior = {p[:2]: float(x) for p, x in zip(patterns, expectation_maximisation(patterns)[0], strict=True)}
    total: Counter = Counter()
    for kind, _, n in patterns:
        total[kind] += n
    share = F.create_map(*[x for k, n in total.items() for x in (F.lit(k), F.lit(min(1.0, max_fit / n)))])
    chosen = spans.filter(F.col("place") < share[F.col("kind")] * F.lit(float(1 << 32)))
    sample = sorted((r["kind"], r["place"], tuple(r["said"]), r["features"]) for r in chosen.limit(2 * max_fit * len(KINDS)).collect())
    return fit([(kind, features, posterior[kind, said]) for kind, _, said, features in sample])


def find(docs: DataFrame, model: Model | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans): all spans of each row as structs (kind, start, end, base), by kind as in KINDS, then start.

    Texts are scanned once; their candidates are a written table, from which the model is made and which it is applied to.
    """
    bounded_batches(docs.sparkSession)
    rows = scanned(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")))
    if model is None:
        rows = materialise(rows, "candidates")
        model = train(rows)
    weights = model.weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            kept = [[{k: c[k] for k in ("kind", "start", "end", "base")} for c in found if c["base"] or own.probability(c["features"]) >= THRESHOLD] for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(work, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>")


def op4_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    found = find(documents(spark, sf_dir))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[number(kind) for kind in BASE],
        F.sha2(F.encode(spelled(base), "utf-8"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
