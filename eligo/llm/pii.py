"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

Base spans are the leftmost matches, not overlapping, of the four kinds' patterns with their
checks. They always stay. The field segments a text into entities and everything else:
candidate segments are runs of up to MOST_TOKENS neighbouring tokens that begin and end with a digit, an
at sign or a spelled-out one; features look at the whole span (digit count, groups, separators, checksum, bounds) and at
the words beside it, and a weight for each pair of neighbouring segments' labels ties them. Tokens outside of entities are
segments of their own. Dynamic
programming over places and labels jointly chooses boundaries
and kinds. Spans it finds that touch no base span are added.

The field is trained in a task on the neighbourhoods of digits and at signs of at most about `limit` texts, chosen by a
hash of the text, no more than PIECES of a text (documented bounds): their base spans, half of them rewritten in ways that the patterns do not know (REWRITTEN),
are the entities; a number that fails its check is an example of what is not personal data.

Defined cases: a null text has no spans; offsets are code points, ends exclusive; texts of any
length are read whole, in time linear in their length; with no base span in the sample nothing is
added; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligo.llm.common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
LIMIT = 8000
PIECES = 8
EXAMPLES = 3000
MOST_TOKENS = 5
OTHER = len(KINDS)
LEARN_TOKENS = 64
PLACES = 1 << 14
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s,;:!?\"<>|]+")
AT, DOT = re.compile(r"[\[({](?:at|AT)[\])}]"), re.compile(r"[\[({](?:dot|DOT)[\])}]")
HINTS = r"[0-9@]|[\[({](at|AT|dot|DOT)[\])}]"


def rewritten(kind: str, text: str, n: int) -> str:
    """A base span, written in the n-th of its kind's other ways."""
    digits = DIGIT.findall(text)
    plain = "".join(digits)
    if kind == "email":
        name, _, host = text.partition("@")
        return (f"{name} (at) {host}", f"{name} [at] {host}", f"{name}@ {host}", f"{name} @ {host}", f"{name}[at]{host}", f"{name} {{at}} {host}")[n % 6]
    if kind == "ip":
        a, b, c, d = text.split(".")
        return (f"{a}.{b}.{c}[.]{d}", f"{a}[.]{b}[.]{c}[.]{d}", f"{a}-{b}-{c}-{d}", f"{a}(.){b}(.){c}(.){d}")[n % 4]
    if kind == "card":
        fours = [plain[i : i + 4] for i in range(0, len(plain), 4)]
        return (".".join(fours), "_".join(fours), "/".join(fours), "--".join(fours))[n % 4]
    a, b, c = plain[-10:-7], plain[-7:-4], plain[-4:]
    return (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{plain}", f"{a} {b} {c}", f"[{a}] {b} {c}")[n % 6]


REWRITTEN = 0.5


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign outwards, so that long words without one cost nothing."""
    end, before, at = 0, -1, text.find("@")
    while at >= 0:
        a = max(end, before + 1)
        run = text[a:at]
        start = a + len(run.rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        before = at
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then by start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def joined(spans) -> str:
    """kind:start:end, by kind as listed and then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _hot(token: str) -> bool:
    return "@" in token or DIGIT.search(token) is not None or AT.search(token) is not None or DOT.search(token) is not None


def neighbourhoods(text: str, most: int | None = None) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens around hot ones, with one before: token bounds. With `most`, longer runs are cut (for learning)."""
    run: list[tuple[int, int]] = []
    quiet, before = 0, None
    for m in TOKEN.finditer(text):
        hot = _hot(m[0])
        if hot and not run and before:
            run.append(before)
        before = m.span()
        if hot or run:
            quiet = 0 if hot else quiet + 1
            run.append(m.span())
            if quiet >= 2:
                yield run[:-1]
                run, quiet = [], 0
            elif most and len(run) >= most and hot:  # long tables of numbers are cut where a token ends
                yield run
                run, quiet, before = [], 0, None
    if run:
        yield run


def segments_from(text: str, tokens: list[tuple[int, int]], i: int) -> Iterator[tuple[int, int, int, int]]:
    """Candidate segments that begin with token i: first token, token after the last, and trimmed bounds."""
    word = lambda k: text[slice(*tokens[k])] if 0 <= k < len(tokens) else ""
    if not (_hot(word(i)) or AT.match(word(i + 1)) or word(i + 1)[:1] == "@"):
        return
    for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
        a, b = tokens[i][0], tokens[j - 1][1]
        if b - a > 80 or "\n" in text[a:b]:
            break
        span = text[a:b].rstrip(".)")
        if not (_hot(word(j - 1)) or j - 2 >= i and (AT.search(word(j - 2)) or word(j - 2)[-1:] == "@")):
            continue
        if span and _hot(span):
            yield i, j, a, a + len(span)


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Candidate segments of a neighbourhood."""
    return [c for i in range(len(tokens)) for c in segments_from(text, tokens, i)]


def span_features(text: str, a: int, b: int) -> list[int]:
    """Hashed places of what the whole span looks like."""
    span = text[a:b]
    digits = "".join(DIGIT.findall(span))
    groups = re.findall("[0-9]+", span)
    other = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", span))))
    before = re.findall(r"\w+", text[max(0, a - 24) : a])
    dotted = span.count(".") == 3 and len(groups) == 4 and re.sub("[0-9.]", "", span) == ""
    said = [
        f"digits{min(len(digits), 24)}", f"groups{min(len(groups), 8)}", f"marks{other}", f"spaces{min(span.count(' '), 5)}", f"plus{span[0] == '+'}",
        f"at{min(span.count('@'), 2)}", f"letters{min(sum(map(str.isalpha, span)), 3)}", f"dotted{dotted and all(len(g) <= 3 and int(g) < 256 for g in groups)}",
        f"card{13 <= len(digits) <= 19 and luhn(digits)}{len(digits) > 12}", f"at.{'@' in span and '.' in span.rpartition('@')[2]}", f"first{span[0] if not span[0].isalnum() else 'x'}",
        f"glued{a > 0 and not text[a - 1].isspace()}{b < len(text) and text[b].isalnum()}", f"word{before[-1].lower() if before else ''}",
        f"shape{re.sub('[A-Za-z]+', 'a', re.sub('[0-9]+', '0', span))[:24]}", f"lengths{','.join(str(min(len(g), 6)) for g in groups[:6])}",
        f"spelled{AT.search(span) is not None}{DOT.search(span) is not None}", f"ends{_hot(span[:1])}{_hot(span[-1:])}", "any",
    ]
    return [zlib.crc32(s.encode("utf-8", "replace")) % PLACES for s in said]


class Field:
    """Weights of span features by kind, and of neighbouring labels (from, to; the last label is none)."""

    def __init__(self, spans: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.spans = np.zeros((PLACES, len(KINDS))) if spans is None else spans
        self.pairs = np.zeros((OTHER + 1, OTHER + 1)) if pairs is None else pairs


def decode(text: str, tokens, field: Field) -> list[tuple[str, int, int]]:
    """Best segmentation of a neighbourhood: its entities. Only best scores and ways back are held, so runs of any length are read whole."""
    n, pairs = len(tokens), field.pairs
    best = np.full((n + 1, OTHER + 1), -np.inf)
    back: list[list] = [[None] * (OTHER + 1) for _ in range(n + 1)]
    best[0, OTHER] = 0.0
    for i in range(n):
        into = best[i][:, None] + pairs  # from label, to label
        way, gain = OTHER - into[::-1].argmax(axis=0), into.max(axis=0)  # of equals, no entity
        if gain[OTHER] > best[i + 1, OTHER]:
            best[i + 1, OTHER], back[i + 1][OTHER] = gain[OTHER], (i, int(way[OTHER]), None)
        for _, j, a, b in segments_from(text, tokens, i):
            scores = gain[:OTHER] + field.spans[span_features(text, a, b)].sum(axis=0)
            for k in range(OTHER):
                if scores[k] > best[j, k]:
                    best[j, k], back[j][k] = scores[k], (i, int(way[k]), (KINDS[k], a, b))
    out, j, label = [], n, OTHER - int(best[n][::-1].argmax())
    while j > 0:
        j, label, entity = back[j][label]
        if entity:
            out.append(entity)
    return out


def _summed(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of sums of exponentials."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(examples: list[tuple[str, list]], epochs: int = 5, rate: float = 0.3, l2: float = 1e-4) -> Field:
    """A field, by stochastic gradient on the log likelihood of the examples' entities."""
    field = Field()
    seen, seen_pairs = np.full(field.spans.shape, 1e-8), np.full(field.pairs.shape, 1e-8)
    work = []
    for text, gold in examples:
        want = {(a, b): KINDS.index(k) for k, a, b in gold}
        for tokens in neighbourhoods(text, LEARN_TOKENS):
            cands = segments(text, tokens)
            truth, place = [], 0
            for c, (i, _, a, b) in sorted(enumerate(cands), key=lambda x: x[1][:2]):
                if (a, b) in want and i >= place:
                    truth.append((c, want[a, b]))
                    place = cands[c][1]
            if cands:
                ending = [[c for c, x in enumerate(cands) if x[1] == j] for j in range(len(tokens) + 1)]
                starting = [[c for c, x in enumerate(cands) if x[0] == i] for i in range(len(tokens))]
                work.append((len(tokens), cands, [np.array(span_features(text, a, b)) for *_, a, b in cands], truth, ending, starting))
    for _ in range(epochs):
        for n, cands, feats, truth, ending, starting in work:
            w, t = field.spans, field.pairs
            s = np.stack([w[f].sum(axis=0) for f in feats])
            ahead, behind = np.full((n + 1, OTHER + 1), -np.inf), np.full((n + 1, OTHER + 1), -np.inf)
            ahead[0, OTHER], into = 0.0, np.full((n + 1, OTHER + 1), -np.inf)
            for j in range(n + 1):
                if j:
                    ahead[j, OTHER] = into[j - 1, OTHER]
                    for c in ending[j]:
                        ahead[j, :OTHER] = np.logaddexp(ahead[j, :OTHER], into[cands[c][0], :OTHER] + s[c])
                into[j] = _summed(ahead[j][:, None] + t, 0)
            behind[n] = 0.0
            for i in range(n - 1, -1, -1):
                after = np.full(OTHER + 1, -np.inf)
                after[OTHER] = behind[i + 1, OTHER]
                for c in starting[i]:
                    after[:OTHER] = np.logaddexp(after[:OTHER], s[c] + behind[cands[c][1], :OTHER])
                behind[i] = _summed(t + after, 1)
            total = float(_summed(ahead[n], 0))
            g = np.stack([np.exp(np.minimum(0, into[x[0], :OTHER] + s[c] + behind[x[1], :OTHER] - total)) for c, x in enumerate(cands)])
            gp = np.zeros(t.shape)
            for i in range(n):
                gp[:, OTHER] += np.exp(np.minimum(0, ahead[i] + t[:, OTHER] + behind[i + 1, OTHER] - total))
                for c in starting[i]:
                    gp[:, :OTHER] += np.exp(np.minimum(0, ahead[i][:, None] + t[:, :OTHER] + s[c] + behind[cands[c][1], :OTHER] - total))
            label, place = OTHER, 0
            for c, k in truth:
                for _ in range(cands[c][0] - place):
                    gp[label, OTHER] -= 1
                    label = OTHER
                gp[label, k] -= 1
                g[c, k] -= 1
                label, place = k, cands[c][1]
            for _ in range(n - place):
                gp[label, OTHER] -= 1
                label = OTHER
            for c, f in enumerate(feats):
                step = g[c] + l2 * w[f]
                np.add.at(seen, f, step * step)
                np.add.at(w, f, -rate * step / np.sqrt(seen[f]))
            gp += l2 * t
            seen_pairs += gp * gp
            t -= rate * gp / np.sqrt(seen_pairs)
    return field


def rewrite(text: str, seed: int) -> tuple[str, list]:
    """A text with about REWRITTEN of its base spans written in other ways, and the bounds of all its entities. Base spans that touch others stay as they are."""
    rng, out, gold, at = np.random.default_rng(seed), [], [], 0
    size = 0
    for k, a, b in sorted(base_spans(text), key=lambda s: s[1]):
        if a < at:
            continue
        said = rewritten(k, text[a:b], int(rng.integers(1000))) if rng.random() < REWRITTEN else text[a:b]
        out += [text[at:a], said]
        size += a - at
        gold.append((k, size, size + len(said)))
        size += len(said)
        at = b
    return "".join([*out, text[at:]]), gold


def _around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The neighbourhoods of sampled texts, PIECES of each."""
    for b in batches:
        out = []
        for h, t in zip(b["h"], b["text"], strict=True):
            pieces = []
            for run in neighbourhoods(t, LEARN_TOKENS):
                a, e = max(0, run[0][0] - 30), min(len(t), run[-1][1] + 30, run[0][0] + 2000)
                pieces.append((zlib.crc32(t[a:e].encode("utf-8", "replace")), a, t[a:e]))
            out += [(h, x, a, piece) for x, a, piece in sorted(pieces)[:PIECES]]
        yield pd.DataFrame(out, columns=["h", "x", "at", "piece"])


def _learned(rows: pd.DataFrame) -> pd.DataFrame:
    """The sample's pieces -> weights that are not zero; place -1 - k holds those of pairs of labels that begin with k."""
    rows = rows.sort_values(["x", "h", "at"]).drop_duplicates("piece").head(EXAMPLES)
    examples = [rewrite(t, int(x)) for t, x in zip(rows["piece"], rows["x"], strict=True)]
    if not any(g for _, g in examples):
        return pd.DataFrame({"place": [], "kind": [], "weight": []}).astype({"place": "int32", "kind": "int32", "weight": "float64"})
    field = train(examples)
    place, kind = np.nonzero(field.spans)
    k, label = np.indices(field.pairs.shape).reshape(2, -1)
    return pd.DataFrame({"place": np.concatenate([place, -1 - k]), "kind": np.concatenate([kind, label]), "weight": np.concatenate([field.spans[place, kind], field.pairs[k, label]])})


def fit(docs: DataFrame, limit: int = LIMIT) -> Field | None:
    """The field learned from a bounded sample, or None if that holds no base span. The driver sees weights only."""
    named = docs.select("text", F.xxhash64("text").alias("h")).where("text is not null")
    sampled = bounded_sample(named, F.col("h"), limit).where(F.col("text").rlike("[0-9@]")).dropDuplicates(["h"])
    rows = sampled.mapInPandas(_around, "h long, x long, at long, piece string").groupBy().applyInPandas(_learned, "place int, kind int, weight double").toPandas()
    if not len(rows):
        return None
    field, here = Field(), rows["place"] >= 0
    field.spans[rows["place"][here], rows["kind"][here]] = rows["weight"][here]
    field.pairs[-1 - rows["place"][~here], rows["kind"][~here]] = rows["weight"][~here]
    return field


def all_spans(text: str | None, base: list, field: Field | None) -> list[tuple[str, int, int]]:
    """Base spans, and those of the field that touch none of them."""
    if not text or field is None:
        return base
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    high = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    out = list(base)
    for tokens in neighbourhoods(text):
        for k, a, b in decode(text, tokens, field):
            at = int(np.searchsorted(starts, b))
            if not at or high[at - 1] <= a:
                out.append((k, a, b))
    return out


def personal_data(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of base spans), base_sha256, spans for each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, limit))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                if not t:
                    rows.append((0, 0, 0, 0, nothing, ""))
                    continue
                base = base_spans(t)
                n = [sum(k == kind for k, *_ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(t, base, model.value))))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out.astype({"doc_id": "object"})

    # texts without a digit or an at sign, spelled out or not, have no spans: they need not go to Python
    text = F.when(F.col("text").rlike(HINTS), F.col("text")).alias("text")
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text)
    return named.mapInPandas(run, schema.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
