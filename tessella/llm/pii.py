"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers, a classifier decides.

1. One pass over whole texts finds the candidates: the base spans (fixed patterns) and number, address and name forms
   that the patterns refuse or do not cover. Each carries the votes of six labelers (1 for, 0 against, -1 silent): a strict
   form and a checksum (regexes), a gazetteer of issuers, country codes, top-level domains or given names, words near it
   that speak for and against it, and what it is embedded in. It also carries a vector of discrete shape features.
2. Candidates are counted by (kind, votes, features), an aggregate over all documents with a bounded number of groups.
   EM over all kinds of a family, base spans and refused ones together, estimates each labeler's hit and false-alarm rate
   and the share of true spans, so that a labeler counts as much as it agrees with the others.
3. A logistic span classifier is trained in numpy on the groups, weighted by count, against the posteriors.
4. Base spans stay whatever it says; of the further candidates those that it accepts join them. Luhn's digit and the
   words near a span are among the features, so a run of digits that fails needs support from its context. ``redact``
   replaces the spans in the text.

Null text is empty. Every input row gives one row; repeated rows are each answered; an empty table gives an empty
result. Spans are code points, end exclusive. Time is linear in a text but for sorting its candidates.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, materialise

# fixed values
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
EXTRA = ("weak_id", "weak_phone", "weak_card", "weak_name", "weak_ip", "weak_email")
ORDER = {k: i for i, k in enumerate((*BASE, *EXTRA))}
_HONORIFIC = r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? [A-Z]"
GATES = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9]){13}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "weak": r"[0-9]{3}[ .-][0-9]{2,4}[ .-][0-9]{4}|\([0-9]{3}\) ?[0-9]{3}|[(\[]at[)\]]|" + _HONORIFIC,
}
GIVEN = frozenset("james john robert michael david mary linda anna peter paul marie julia hans maria jose juan luis carlos pierre jean claire sophie thomas daniel laura".split())
TLDS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca ch at be jp".split())
COUNTRY = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "353", "351", "420", "971", "972")
ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[4-9]|6[0245]|35")
FOR = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt|from|to)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|address|server|login|client|adresse)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|iban|karte|carte|tarjeta|paid)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|appeler|llamar)\b"),
    "id": re.compile(r"(?i)\b(?:ssn|social security|passport|national id|id no|ausweis|dni|nif)\b"),
    "name": re.compile(r"(?i)\b(?:name|signed|contact|dear|sincerely|born|patient|customer)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:order|invoice|page|isbn|version|release|sku|total|figure|table|article|section)\b")
FORM = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    "card": re.compile(r"[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"),
    "phone": re.compile(r"\+?[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}"),
    "id": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "name": re.compile(r"[A-Za-z]+\.? [A-Z][a-z]+ [A-Z][a-z]+"),
}
CANDIDATES = {
    "weak_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "weak_phone": re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])"),
    "weak_name": re.compile(_HONORIFIC + r"[a-z]+(?: [A-Z][a-z]+)?"),
    "weak_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,64}(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{1,64}|\.[A-Za-z0-9-]{1,64})+"),
}
LABELERS, FEATURES = ("form", "checksum", "gazetteer", "context", "against", "embedded"), 8


def family(kind: str) -> str:
    """What a kind is a form of; EM and classifier take a family's kinds together."""
    return kind.removeprefix("weak_")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, from one '@' to the next, so that long runs of word characters stay linear."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and _LOCAL.match(text[lo - 1]):
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


Span = tuple[int, int, str]


def base_spans(text: str, kinds=BASE) -> tuple[list[Span], list[Span]]:
    """(base spans, runs of digits that fail as cards or addresses)."""
    out, failed = [], []
    if "email" in kinds:
        out += [(a, b, "email") for a, b in emails(text)]
    if "ip" in kinds:
        for m in _IP.finditer(text):
            fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
            (out if fits else failed).append((m.start(), m.end(), "ip" if fits else "weak_ip"))
    if "card" in kinds:
        for m in _CARD.finditer(text):
            d = digits(m[0])
            if 14 <= len(d) <= 19:
                fits = luhn(d)
                (out if fits else failed).append((m.start(), m.end(), "card" if fits else "weak_card"))
    if "phone" in kinds:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return out, failed


def votes(kind: str, span: str, near: str, beside: str) -> list[int]:
    """Of the labelers, in order: 1 for, 0 against, -1 silent. ``beside`` is the character on either side."""
    of, d = family(kind), digits(span)
    form, checksum, gazetteer = int(bool(FORM[of].fullmatch(span))), -1, -1
    if of == "card":
        checksum, gazetteer = int(luhn(d)), int(bool(ISSUER.match(d)))
    elif of == "ip":
        parts = [p.lstrip("0") or "0" for p in span.split(".")]
        checksum = int(all(len(p) <= 3 and int(p) <= 255 for p in parts))
        gazetteer = 0 if parts[0] in ("0", "255") or len(set(parts)) == 1 else 1
    elif of == "phone":
        checksum = int(len(set(d)) > 2 and len(d) >= 10)
        gazetteer = int(d.startswith(COUNTRY)) if span[0] == "+" else 0 if d[:3] in ("000", "123") else -1
    elif of == "id":
        checksum = int(len(set(d)) > 2)
    elif of == "email":
        gazetteer = int(re.split(r"[.)\] ]", span)[-1].lower() in TLDS)
    else:
        gazetteer = 1 if any(w.lower() in GIVEN for w in span.split()[1:]) else -1
    embedded = 0 if any(c.isalnum() or c in "_=/#@" for c in beside) else 1
    return [form, checksum, gazetteer, 1 if FOR[of].search(near) else -1, 0 if AGAINST.search(near) else -1, embedded]


def features(kind: str, span: str, near: str) -> list[int]:
    of, d = family(kind), digits(span)
    sound = luhn(d) if of == "card" else FORM[of].fullmatch(span)
    return [int(bool(d) and len(set(d)) >= 5), int("-" in span), int(" " in span), int("(" in span), int(bool(sound)), int(bool(FOR[of].search(near))), int(bool(AGAINST.search(near))), int(kind in BASE)]


def candidates(text: str, base: list[Span], failed: list[Span], extra: bool = True) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of the base spans and of further spans that overlap none of them; the pattern is
    votes and features."""
    more = [*failed, *((m.start(), m.end(), k) for k, p in CANDIDATES.items() for m in p.finditer(text))] if extra else failed
    lo, hi = [], []  # of base spans, those that overlap as one
    for a, b, _ in sorted(base):
        if hi and a < hi[-1]:
            hi[-1] = max(hi[-1], b)
        else:
            lo.append(a)
            hi.append(b)
    free = [x for x in more if bisect_right(hi, x[0]) == bisect_left(lo, x[1])]
    out = []
    for a, b, kind in sorted([*base, *free], key=lambda x: (x[0], ORDER[x[2]])):
        near, beside = text[max(0, a - 40) : a] + " " + text[b : b + 20], text[max(0, a - 1) : a] + text[b : b + 1]
        v, f = votes(kind, text[a:b], near, beside), features(kind, text[a:b], near)
        out.append((kind, a, b, "".join("xny"[i + 1] for i in v) + "".join(map(str, f))))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], ORDER[x[2]], x[1])))


def parsed(spans: str) -> list[tuple[int, int, str]]:
    return [(int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, candidates array<struct<kind:string,start:long,stop:long,pattern:string>>"
_FOUND = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("base", pa.string()), ("candidates", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("pattern", pa.string())])))]
)
_EMPTY = hashlib.sha256(b"").hexdigest()


def find_in(text: str, kinds=(*BASE, "weak")) -> tuple[list, list]:
    base, failed = base_spans(text, kinds)
    return base, candidates(text, base, failed, "weak" in kinds)


def find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, text = b.num_rows, pc.fill_null(b.column(1), "")
        hit = {k: pc.match_substring_regex(text, p) for k, p in GATES.items()}
        any_hit = hit["email"]
        for k in ("ip", "card", "phone", "weak"):
            any_hit = pc.or_(any_hit, hit[k])
        counts, sha, base_s, cand = {k: [0] * n for k in BASE}, [_EMPTY] * n, [""] * n, [[]] * n
        for r in pc.indices_nonzero(any_hit).to_pylist():
            base, cands = find_in(text[r].as_py(), [k for k in GATES if hit[k][r].as_py()])
            for _, _, k in base:
                counts[k][r] += 1
            base_s[r] = joined(base)
            sha[r] = hashlib.sha256(base_s[r].encode()).hexdigest()
            cand[r] = [dict(zip(("kind", "start", "stop", "pattern"), c, strict=True)) for c in cands]
        yield batch(_FOUND, doc_id=b.column(0), **{f"n_{k}": v for k, v in counts.items()}, base_sha256=sha, base=base_s, candidates=cand)


def posteriors(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """EM over vote patterns (1, 0 or -1 a labeler) that occur n times each: P(true) of each pattern, the share of true
    spans and, per labeler that speaks, P(yes | true) and P(yes | false).

    Silence is an answer with a rate of its own in either class. It starts from the votes that differ from a labeler's
    usual one, so that a labeler who always says the same says nothing; a prior of a few votes keeps its sense.
    """
    said = np.stack([votes == 1, votes == 0, votes == -1]).astype(float)  # answer, pattern, labeler
    sense = said[0] - said[1]
    post = 1 / (1 + np.exp(-2 * (sense - n @ sense / n.sum()).sum(1)))
    for _ in range(rounds):
        w = np.stack([n * post, n * (1 - post)])
        share = float(np.clip(w[0].sum() / n.sum(), 0.02, 0.98))
        prior = np.array([[2, 0.5, 1], [0.75, 1.25, 1]])
        rate = np.einsum("cp,apl->cal", w, said) + prior[:, :, None]
        rate /= rate.sum(1, keepdims=True)
        lt, lf = (np.einsum("apl,al->p", said, np.log(r)) for r in rate)
        post = 1 / (1 + np.exp(np.clip(lf + np.log(1 - share) - lt - np.log(share), -50, 50)))
    hit, alarm = rate[:, 0] / (rate[:, 0] + rate[:, 1])
    return post, share, hit, alarm


def estimate(groups: list[tuple[str, str, int]]) -> dict[str, dict]:
    """Of (kind, pattern, count), for each family: the share of true spans, each labeler's rates by EM, and the weights of
    a logistic classifier over the shape features, fitted to the posteriors. Counts and weights are all it sees."""
    out = {}
    for of in sorted({family(g[0]) for g in groups}):
        own = [(p, n) for k, p, n in groups if family(k) == of]
        n = np.array([c for _, c in own], float)
        v = np.array([["xny".index(ch) - 1 for ch in p[: len(LABELERS)]] for p, _ in own])
        x = np.array([[int(ch) for ch in p[len(LABELERS) :]] + [1] for p, _ in own], float)
        post, share, hit, alarm = posteriors(v, n)
        weights = np.zeros(FEATURES + 1)
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            weights -= 0.5 * (x.T @ (n * (p - post)) / n.sum() + 1e-3 * weights)
        out[of] = {"share": share, "for": hit.tolist(), "against": alarm.tolist(), "weights": weights.tolist()}
    return out


def accepts(model: dict[str, dict], kind: str, pattern: str) -> bool:
    """Whether the classifier takes a candidate for personal data."""
    m = model.get(family(kind))
    return bool(m) and float(np.dot(m["weights"], [*map(int, pattern[len(LABELERS) :]), 1])) > 0


def detect(docs: DataFrame, name: str = "pii") -> DataFrame:
    """One row per document: counts, digest and spans. One pass over the texts; its findings are a written table.

    The table of vote patterns that goes to the driver has at most 3**6 * 2**8 rows a kind, whatever the input.
    """
    found = materialise(docs.select("doc_id", "text").mapInArrow(find_batches, FOUND), name)
    grouped = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.pattern").count()
    groups = sorted((r[0], r[1], r[2]) for r in grouped.collect())
    model = estimate(groups)
    good = [f"{k}|{p}" for k, p, _ in groups if k in EXTRA and accepts(model, k, p)]  # bounded as the groups are
    kept = F.filter("candidates", lambda c: F.concat_ws("|", c["kind"], c["pattern"]).isin(good)) if good else F.filter("candidates", lambda c: F.lit(False))
    more = F.transform(kept, lambda c: F.struct(c["start"].alias("a"), F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string")).alias("s")))
    mine = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("long").alias("a"), s.alias("s")))
    rank = lambda s: F.array_position(F.array(*map(F.lit, ORDER)), F.split(s, ":")[0])
    keyed = F.transform(F.concat(mine, more), lambda x: F.struct(x["a"].alias("a"), rank(x["s"]).alias("r"), x["s"].alias("s")))
    spans = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), ",")
    return found.select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", spans.alias("spans"), F.size(kept).cast("long").alias("n_weak"))


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span, overlaps merged, replaced by its kind in brackets."""
    out, done = [], 0
    for a, b, k in sorted(spans, key=lambda x: (x[0], ORDER[x[2]])):
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and n_chars made to fit. The model is fitted on a first pass
    over all documents; a second pass finds the spans again and replaces them, so no join moves the texts."""
    grouped = docs.select("doc_id", "text").mapInArrow(find_batches, FOUND).select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.pattern").count()
    model = estimate(sorted((r[0], r[1], r[2]) for r in grouped.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            text = b.column(at)
            hit = None
            for p in GATES.values():
                h = pc.match_substring_regex(pc.fill_null(text, ""), p)
                hit = h if hit is None else pc.or_(hit, h)
            rows = pc.indices_nonzero(hit).to_pylist()
            if rows:
                values = text.to_pylist()
                for r in rows:
                    base, cands = find_in(values[r])
                    spans = base + [(s, e, k) for k, s, e, p in cands if k in EXTRA and accepts(model, k, p)]
                    while spans:  # what is left may hold a span that one beside it had hidden
                        values[r] = redact_text(values[r], spans)
                        spans = base_spans(values[r])[0]
                b = b.set_column(at, b.schema.field(at), pa.array(values, b.schema.field(at).type))
            yield b

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in out.columns else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
