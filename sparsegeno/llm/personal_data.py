"""Personal data: candidate spans scored by gradient-boosted trees.

Base spans (email, ip, card, phone) come from fixed patterns with validators and always
stay. Generators of high recall propose further, overlapping spans; boosted trees score
each by its format and context; spans at or above their kind's threshold, calibrated for
precision on rows kept out of the fit, are redacted, the best first where they overlap.

The labels of the fit are known because the spans are planted: made-up secrets, accounts and
contacts, with and without a cue before them, and look-alikes (dates, versions, order numbers,
commits, identifiers) are put into snippets of at most about ``SAMPLE_DOCS`` documents chosen
by hash, ``PLANTED`` of them in all. A proposal that is a planted secret, account or contact is of
the first class, any other that touches a planted span of the second. Every document is searched whole.

Defined results: null and empty texts have no spans. Positions are code points, ends
exclusive. Equal texts get equal spans. Extra columns are ignored or carried along.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "contact")
SAMPLE_DOCS, PLANTED = 4000, 8000
#: Characters of a snippet; candidates that are scored at once.
SNIPPET, SCORED = 160, 20_000
#: Each kind's threshold keeps at least this precision on the calibration rows.
PRECISION = 0.97
CONTEXT = 24

Span = tuple[str, int, int]

# The patterns are those asked for, with possessive runs where backing up cannot help.
_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_digit = re.compile(r"[0-9]").search
_local_chars = frozenset(string.ascii_letters + string.digits + "._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left over the local part and to the right over the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local_chars:
            start -= 1
        found = _domain(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Validated base spans, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _digit(text):
        return out
    for m in _ip(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _card(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _phone(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# Generators: every run that could be a key, an account or a contact.
_secret = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+").finditer
# what follows a name for secrets, an assignment or not
_named = re.compile(
    r"(?:password|passwd|passphrase|pwd|secret|token|key|auth|bearer)[\"']?[ \t]?[:=]?[ \t]?[\"']?([^\s\"',;:=]{8,}+)", re.I
).finditer
# not possessive: the run can enter a following word and must back out of it (by 26 steps at most)
_account = re.compile(r"(?<![A-Za-z0-9])[A-Z]{0,2}[0-9](?:[ ./-]?[A-Z0-9]){7,33}(?![A-Za-z0-9])").finditer
_unbroken = re.compile(r"(?<![A-Za-z0-9])[A-Z]{0,2}[0-9][A-Z0-9]{33,}+(?![A-Za-z0-9])").finditer
# where words in capitals begin: those that end the run, and, in a number, any of three letters or more
_words_last = re.compile(r"(?:[ ./-][A-Z]+)++\Z").finditer
_words = re.compile(r"[ ./-](?=[A-Z]{3,}(?![A-Z0-9]))|(?:[ ./-][A-Z]+)++\Z").finditer
_contact = re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ .-]?[0-9]{2,5}){2,4}+(?![0-9])").finditer
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "key", "auth", "bearer")
CUES = {
    "secret": (*NAMES, "apikey", "apitoken"),
    "account": ("iban", "account", "acct", "ssn", "passport", "insurance", "tax", "licence no"),
    "contact": ("phone", "tel", "call", "mobile", "fax", "contact"),
}
OTHER_CUES = ("commit", "order", "isbn", "version", "page", "date", "sha", "ticket", "invoice", "doi", "lot", "model")


def _begins_word(words: tuple[str, ...]) -> Callable:
    """Search for any of the words where no letter stands before it."""
    return re.compile(rf"(?<![^\W\d_])(?:{'|'.join(words)})").search


_cue = {kind: _begins_word(words) for kind, words in CUES.items()}
_other_cue = _begins_word(OTHER_CUES)


def candidates(text: str) -> list[Span]:
    """Overlapping spans that may be personal data."""
    out: set[Span] = {("secret", *m.span()) for m in _secret(text)}
    low = text.lower()
    if any(name in low for name in NAMES):
        out |= {("secret", *m.span(1)) for m in _named(text)}
    if _digit(text):
        out |= {("contact", *m.span()) for m in _contact(text)}
        out |= {("account", *m.span()) for m in _unbroken(text)}
        for m in _account(text):
            a, b = m.span()
            out.add(("account", a, b))
            # capitals after an account may be words: it is proposed with and without them
            for w in (_words if text[a].isdigit() else _words_last)(m[0]):
                if sum(map(str.isalnum, text[a : a + w.start()])) >= 8:
                    out.add(("account", a, a + w.start()))
    return sorted(out)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in map(s.count, set(s)))


_date = re.compile(r"(?:19|20)[0-9]{2}[-./ ]?[01][0-9][-./ ]?[0-3][0-9]|[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}").match


def iban_ok(s: str) -> bool:
    """The check digits of an international account number."""
    t = s.replace(" ", "")
    if not (15 <= len(t) <= 34 and t[:2].isalpha() and t.isalnum() and t.isascii()):
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def span_features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    before = text[max(0, a - CONTEXT) : a].lower()
    n = len(s)
    counts = {c: s.count(c) for c in set(s)}

    def share(of: str) -> float:
        return sum(counts.get(c, 0) for c in of) / n

    digits, upper = share(string.digits), share(string.ascii_uppercase)
    letters = upper + share(string.ascii_lowercase)
    numbers = "".join(filter("0123456789".__contains__, s)) if kind != "secret" and n <= 40 else ""
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(s[:200], s[1:201], strict=False)) / min(n, 200)
    return [
        float(KINDS.index(kind)),
        float(min(n, 200)),
        digits,
        letters,
        share("0123456789abcdefABCDEF"),
        upper,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        changes,
        float(_cue[kind](before) is not None),
        float(_other_cue(before) is not None),
        float(before.rstrip("\"' ").endswith(("=", ":"))),
        float(before.endswith(('"', "'")) and text[b : b + 1] in ('"', "'")),
        share(" ./-()") * n,
        float(len(numbers) >= 12 and luhn(numbers)),
        float(kind == "account" and iban_ok(s)),
        share("aeiouAEIOU"),
        float(_date(s) is not None),
        float(len(numbers)),
    ]


def _iban(r: random.Random) -> str:
    country, rest = r.choice(("DE", "GB", "FR", "NL", "ES")), "".join(r.choices(string.digits, k=r.randint(12, 20)))
    left = int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
    s = f"{country}{98 - left:02d}{rest}"
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.6 else s


def _digits(r: random.Random, pattern: str) -> str:
    return "".join(r.choice(string.digits) if c == "#" else c for c in pattern)


def planted(r: random.Random) -> tuple[str, str, str, str]:
    """Text before, the span, text after, and its kind ("" for a look-alike)."""
    alnum, word = string.ascii_letters + string.digits, lambda: "".join(r.choices(string.ascii_lowercase, k=r.randint(3, 9)))
    lead, kind = r.choice(("", "the ", "my ", "see ", f"{word()} ")), r.randrange(6)
    if kind == 0:
        letters = r.choice(("0123456789abcdef", alnum, alnum + "+/", alnum + "_-"))
        value = r.choice(("", "", "sk_", "ghp_", "AKIA")) + "".join(r.choices(letters, k=r.choice((20, 24, 32, 40, 64))))
        before, after = r.choice((('token = "', '"'), ("api_key: ", ""), ("Bearer ", ""), ("secret=", " "), ("'", "'"), ("export KEY=", ""), ("", "")))
        return lead + before, value, after, "secret"
    if kind == 1:
        value = word() + r.choice(("", "-", "_", "!", "7", "42")) + word() + r.choice(("", "#", "99", word()))
        before, after = r.choice((('password = "', '"'), ("password: ", ""), ("pwd=", ""), ("passphrase: '", "'")))
        return lead + before, value, after, "secret" if len(value) >= 8 else ""
    if kind == 2:
        value = _iban(r) if r.random() < 0.5 else _digits(r, r.choice(("########", "##########", "############", "###-##-####", "#### #### ####")))
        cue = r.choice(("account ", "IBAN: ", "acct no. ", "SSN ", "passport ", "tax id ", "pay to account "))
        return lead + (cue if value[0].isdigit() or r.random() < 0.6 else ""), value, r.choice(("", ".", ",", " For")), "account"
    if kind == 3:
        value = _digits(r, r.choice(("(###) ###-####", "###-###-####", "0## #### ####", "### ### ####", "0####-######", "###.###.####")))
        cue = r.choice(("phone ", "tel. ", "call ", "mobile: ", "fax ", "contact ", "call me on "))
        return lead + cue, value, r.choice(("", ".", ",", " now")), "contact"
    shapes = ("2###-1#-2#", "1#/0#/19##", "v#.#.##", "978-#-##-######-#", "20##120#T######", "###,###.##", "## ## ## ##", "########", "####-####", "################", "20## 20## 20##",
        "## ## ## ## ##", "### ### ###", "### ### ####", "##-##-##-##", "#### ####", "## ### ## ###")
    if kind == 4:
        value = _digits(r, r.choice(shapes))
        cue = r.choice(("", "", "order ", "version ", "on ", "ISBN ", "page ", "invoice ", "about ", "of "))
    else:
        value = r.choice((
            "".join(r.choices("0123456789abcdef", k=40)), "_".join(word() for _ in range(4)), "-".join(word() for _ in range(4)),
            word() + word() + word(), word() + word(), "/".join(word() for _ in range(4)), "=" * r.randint(16, 60), "-" * r.randint(16, 60),
            f"img_20{_digits(r, '######_####')}_{word()}", word().upper() + " " + _digits(r, "## ####"),
        ))
        if value.isalpha() and value.islower():
            return lead + r.choice(("key ", "password ", "secret ", "token ", "in ")), value, r.choice(("", ".", ",")), ""
        cue = r.choice(("commit ", "sha ")) if len(value) == 40 and set(value) <= set("0123456789abcdef") else r.choice(("", "see ", "in "))
    return lead + cue, value, r.choice(("", ".", ",")), ""


def planted_rows(snippets: list[str], n: int, seed: int = 7) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the proposals that touch n planted spans."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        where = snippets[i % len(snippets)] if snippets else "and then it was said"
        cut = where.find(" ", r.randrange(len(where) + 1)) + 1
        before, value, after, kind = planted(r)
        text = f"{where[:cut]}{before}{value}{after} {where[cut:]}"
        a = cut + len(before)
        b = a + len(value)
        for c in candidates(text):
            if c[1] < b and a < c[2]:
                rows.append(span_features(text, c))
                labels.append(int(c == (kind, a, b)))
    return rows, labels


class BoostedTrees:
    """Binary gradient boosting with small regression trees over quantile bins (logistic loss)."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 32, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        levels = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, levels)) for c in x.T]
        binned = self._bin(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(p / (1 - p))
        score = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - q, q * (1 - q), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self.rate * self._apply(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _grow(self, b, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = g / (h + self.least)
        if depth == 0 or len(rows) < 8:
            return leaf
        best, split = 1e-6, None
        for f in range(b.shape[1]):
            k = len(self.edges[f]) + 1
            gs = np.cumsum(np.bincount(b[rows, f], grad[rows], k))[:-1]
            hs = np.cumsum(np.bincount(b[rows, f], hess[rows], k))[:-1]
            if not len(gs):
                continue
            gain = gs**2 / (hs + self.least) + (g - gs) ** 2 / (h - hs + self.least) - g**2 / (h + self.least)
            i = int(gain.argmax())
            if gain[i] > best:
                best, split = gain[i], (f, i)
        if split is None:
            return leaf
        left = b[rows, split[0]] <= split[1]
        return (*split, *(self._grow(b, grad, hess, rows[m], depth - 1) for m in (left, ~left)))

    def _apply(self, tree, b: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        f, i, low, high = tree
        return np.where(b[:, f] <= i, self._apply(low, b), self._apply(high, b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        score = self.start + self.rate * sum(self._apply(t, b) for t in self.trees)
        return 1 / (1 + np.exp(-score))


def calibrated(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest threshold whose precision on held-out rows is at least ``precision``."""
    by = np.argsort(-p, kind="stable")
    good = np.cumsum(y[by]) / np.arange(1, len(y) + 1)
    last = np.append(p[by][1:] != p[by][:-1], True)  # ties stand or fall together
    fine = np.nonzero((good >= precision) & last)[0]
    return float(p[by][fine[-1]]) if len(fine) else 1.1


Model = tuple[BoostedTrees, np.ndarray]


def fitted(snippets: list[str], n: int = PLANTED) -> Model:
    """Trees, and one threshold per kind."""
    x, y = (np.array(v, float) for v in planted_rows(snippets, n))
    held = np.random.default_rng(11).permutation(len(y)) % 4 == 0
    trees = BoostedTrees().fit(x[~held], y[~held])
    p, kinds = trees.predict(x[held]), x[held, 0]
    return trees, np.array([calibrated(p[kinds == k], y[held][kinds == k]) for k in range(len(KINDS))])


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds from spans planted in a bounded sample of snippets."""
    mark = F.xxhash64("doc_id", "text")
    limit = 2.0**63 * min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    chosen = docs.where(F.col("text").isNotNull() & (F.abs(mark.cast("double")) <= limit))
    place = F.pmod(mark, F.greatest(F.length("text") - SNIPPET, F.lit(1))).cast("int") + 1
    # repeated rows have one mark
    rows = chosen.select(mark.alias("h"), F.substring("text", place, F.lit(SNIPPET)).alias("s")).distinct()
    return fitted([r["s"] for r in rows.orderBy("h", "s").limit(SAMPLE_DOCS).collect()])


def _select(found: list[Span], scores: np.ndarray, thresholds: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans at or above their threshold, best first, that overlap no base span and none chosen before."""
    starts, ends, out = [], [], []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    ranked = sorted(zip(scores.tolist(), found, strict=True), key=lambda x: (-x[0], x[1][1], x[1]))
    for p, (kind, a, b) in ranked:
        if p < thresholds[KINDS.index(kind)]:
            continue
        i = bisect.bisect_right(starts, a)
        if (i == 0 or ends[i - 1] <= a) and (i == len(starts) or b <= starts[i]):
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((kind, a, b))
    return out


def find_spans(texts: list[str], model: Model) -> Iterator[tuple[list[Span], list[Span]]]:
    """Per text its base spans and the added ones; candidates are scored many at once."""
    trees, thresholds = model
    found = [candidates(t) for t in texts]
    every = [(t, c) for t, cs in zip(texts, found, strict=True) for c in cs]
    scores = [np.zeros(0)]
    for i in range(0, len(every), SCORED):
        scores.append(trees.predict(np.array([span_features(t, c) for t, c in every[i : i + SCORED]])))
    score, i = np.concatenate(scores), 0
    for t, cs in zip(texts, found, strict=True):
        base = base_spans(t)
        yield base, _select(cs, score[i : i + len(cs)], thresholds, base) if cs else []
        i += len(cs)


def _joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))  # some hundred numbers
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = []
                for base, added in find_spans(texts, model.value):
                    kinds = [k for k, _, _ in base]
                    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                    rows.append((*map(kinds.count, BASE_KINDS), digest, _joined(base + added), len(added)))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact_text(text: str, spans: list[Span]) -> str:
    """Each maximal union of overlapping spans becomes [KIND] of its first span."""
    out, at, i = [], 0, 0
    ordered = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(ordered):
        kind, a, b = ordered[i]
        i += 1
        while i < len(ordered) and ordered[i][1] < b:
            b = max(b, ordered[i][2])
            i += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in ``text``; null texts stay null."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))  # some hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                raw = part.column(at).to_pylist()
                texts = [x or "" for x in raw]
                new = [
                    None if r is None else redact_text(t, base + added)
                    for r, t, (base, added) in zip(raw, texts, find_spans(texts, model.value), strict=True)
                ]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
