"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers in plain spelling. The field adds spans that
they miss: it cuts the text around digits and at signs into segments of at most ``MAX_CHUNKS`` words, scores every
segment as a whole (its features see the entire span) and chooses boundaries and types together by dynamic programming,
which holds the scores of the last ``MAX_CHUNKS`` words only. A spelled-out address that the field has found goes on as long as
dots and labels follow, so hosts may have any number of labels.
It is trained here by gradient ascent on the likelihood of a bounded sample of windows: those that the patterns label,
and copies in which the labelled spans are written otherwise (``name at host dot org``, a phone number without its
country code) or give way to dates, times, numbers of orders and versions, and hosts behind an ordinary "at". These, and digits that no
pattern accepts, are examples of "nothing". Kinds of spans are trained in equal parts, whatever their shares of the sample are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.llm.common import plain_names

KINDS = ("email", "ip", "card", "phone")
NOTHING = len(KINDS)
MAX_CHUNKS = 7
MAX_CHARS = 320  # an address: 64 characters before the at sign, 255 behind it
AROUND = 6  # words on either side of a digit or at sign that a window takes in
TRAINING_WINDOWS = 320
ROUNDS = 10
CLEAR = 2.0  # a segment is taken only if its score beats "nothing" by so much

_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_digits = re.compile("[0-9]+")
_trigger = re.compile("[0-9@]").search
_hint = re.compile(r"[0-9@]|\b[Aa][Tt]\b|\([Aa][Tt]\)|\[[Aa][Tt]\]").search
_word = re.compile(r"\S+")
_dot_word = re.compile(r"\W*dot\W*", re.IGNORECASE).fullmatch
_dot_inside = re.compile(r"[(\[]dot[)\]]", re.IGNORECASE).search
_at_host = re.compile(r"(?:[(\[]at[)\]]|(?<!\w)at(?!\w))[)\]\s]*[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}", re.IGNORECASE).search
_more_host = re.compile(r"(?:\s+dot\s+|\s*[(\[]\s*dot\s*[)\]]\s*)[a-z0-9-]+", re.IGNORECASE).match
_date = re.compile(r"(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![0-9])").search
_plain_at = re.compile(r"([a-z]+)\s+at\s").match
#: Words that stand before "at" in prose about a place on the web, and are no names of mailboxes there. Fixed values.
BEFORE_AT = frozenset(
    "look looked looking looks see seen read found find visit visited meet met meets us me is are was were be hosted available online"
    " here site page pages more website published posted listed located shown them it buy sold live lives stay home arrive arrived"
    " left work works order ordered start starts started aimed back and or not".split()
)
_spelled = re.compile(
    r"[a-z0-9._%+-]+(?:\s+at\s+|\s*[(\[]\s*at\s*[)\]]\s*)[a-z0-9-]+"
    r"(?:(?:\s+dot\s+|\s*[(\[]\s*dot\s*[)\]]\s*|\.)[a-z0-9-]+)*(?:\s+dot\s+|\s*[(\[]\s*dot\s*[)\]]\s*|\.)[a-z]{2,}"
).fullmatch


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _place(span: tuple[int, int, int]) -> tuple[int, int]:
    return span[0], span[2]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points of the plain spellings, by start and then kind. Linear in the text."""
    if not text or not _trigger(text):
        return []
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        host = _domain.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end(), 0))
            end = host.end()
        at = text.find("@", max(end, at + 1))
    found += [(m.start(), m.end(), 1) for m in _ip.finditer(text) if _octets(m.group())]
    for kind, pattern, least, most in ((2, _card, 12, 19), (3, _phone, 9, 15)):
        for m in pattern.finditer(text):
            digits = "".join(_digits.findall(m.group()))
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=_place)


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) around digits, at signs and the word "at"; runs that touch are one."""
    if not _hint(text):
        return []
    words = [m.span() for m in _word.finditer(text)]
    hot = [i for i, (a, b) in enumerate(words) if _hint(text, a, b)]
    runs: list[list[int]] = []
    for i in hot:
        if not _trigger(text, *words[i]) and not _dots(text, words, i):
            continue
        a, b = max(0, i - AROUND), min(len(words), i + AROUND + 1)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return [words[a:b] for a, b in runs]


def _dots(text: str, words: list[tuple[int, int]], i: int) -> bool:
    """True if a spelled-out dot is in word ``i`` or follows it closely, or a dotted host follows its "at": "at" alone is no trace of an address."""
    start = words[i][0]
    if _dot_inside(text, *words[i]) or _at_host(text[start : min(words[min(i + 2, len(words) - 1)][1], start + 4 * MAX_CHARS)]):
        return True
    return any(_dot_word(text, a, b) or _dot_inside(text, a, b) for a, b in words[i + 1 : i + MAX_CHUNKS])


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends; a phone number keeps its plus and bracket."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


FEATURES = 36
SPELLED = 6  # the feature of a spelled-out address


def span_features(text: str, start: int, end: int, n_words: int, before: str) -> np.ndarray:
    """What the whole segment looks like."""
    s = text[start:end]
    digits = "".join(_digits.findall(s))
    n, letters = len(digits), sum(c.isalpha() for c in s)
    groups = [len(g) for g in _digits.findall(s)]
    low = s.lower()
    spelled = bool(_spelled(low))
    plain = "@" in s and bool(re.fullmatch(r"[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)+", low))
    quad = bool(re.fullmatch(r"[0-9]{1,9}(\.[0-9]{1,9}){3}", s)) and _octets(s)
    at = _plain_at(low) if spelled else None
    parted = ":" in s or "/" in s and groups != [4, 4, 4, 4]
    bracketed = bool(re.fullmatch(r"\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}", s))
    return np.array(
        [
            1, n_words == 1, n_words == 2, n_words == 3, n_words >= 4, plain, spelled, "@" in s, quad, "." in s,
            n == 0, 1 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19, 12 <= n <= 19 and letters == 0 and luhn(digits),
            12 <= n <= 19 and letters == 0 and not luhn(digits), s.startswith("+"), s.startswith("+") and 9 <= n <= 15 and letters == 0,
            bracketed, groups[-3:] == [3, 3, 4] and letters == 0, groups in ([4, 4, 4, 4], [16]) and letters == 0, letters > 0,
            letters > 0 and n > 4, low == "", '"' in before or "=" in before, before.endswith("+"), end - start > MAX_CHARS, len(s) > 40,
            spelled and at is None, at is not None and at[1] in BEFORE_AT, at is not None and at[1] not in BEFORE_AT, parted and letters == 0,
            letters == 0 and n > 0 and bool(_date(s)), groups == [4, 4, 4, 4] and "/" in s and luhn(digits),
        ],
        np.float64,
    )


def possible(text: str, start: int, end: int) -> np.ndarray:
    """Whether the segment may be each kind at all, however it scores: what can only be something else is nothing."""
    s = text[start:end]
    digits = "".join(_digits.findall(s))
    low, bare = s.lower(), not any(c.isalpha() for c in s)
    return np.array(
        [
            "@" in s or " at " in low or "(at)" in low or "[at]" in low,
            bare and len(_digits.findall(s)) == 4 and len(digits) <= 12 and all(int(g) <= 255 for g in _digits.findall(s)),
            bare and 12 <= len(digits) <= 19 and luhn(digits),
            bare and 9 <= len(digits) <= 15,
        ]
    )


class SemiCrf:
    """Weights of whole-span features per label and of neighbouring labels."""

    def __init__(self):
        self.weights = np.zeros((NOTHING + 1, FEATURES))
        self.moves = np.zeros((NOTHING + 1, NOTHING + 1))

    def segment(self, text: str, words: list[tuple[int, int]], i: int, j: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Features and possible kinds of the words from i to before j; None if more than one word cannot be any kind."""
        start, end = _trim(text, words[i][0], words[j - 1][1])
        kinds = np.zeros(NOTHING, bool)
        if end - start <= MAX_CHARS and (j == i + 1 or _hint(text, start, end)):
            kinds = possible(text, start, end)
        if j > i + 1 and not kinds.any():
            return None
        return span_features(text, start, min(end, start + 4 * MAX_CHARS), j - i, text[max(0, words[i][0] - 4) : words[i][0]]), kinds

    def segments(self, text: str, words: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """Features and possible kinds of all candidate segments, by first word and end."""
        all_of = {(i, j): self.segment(text, words, i, j) for i in range(len(words)) for j in range(i + 1, min(len(words), i + MAX_CHUNKS) + 1)}
        return {place: found for place, found in all_of.items() if found is not None}

    def score(self, n_words: int, features: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        s = self.weights @ features
        s[:NOTHING][~kinds] = -np.inf
        if n_words > 1:
            s[NOTHING] = -np.inf  # what is nothing stands word by word
        return s

    def scores(self, segments: dict) -> dict[tuple[int, int], np.ndarray]:
        return {(i, j): self.score(j - i, *found) for (i, j), found in segments.items()}

    def likelihood_step(self, n: int, segments: dict, truth: list[tuple[int, int, int]], rate: float) -> None:
        """One step up the gradient of the log-likelihood: features of the truth minus expected features."""
        scores = self.scores(segments)
        forward = np.full((n + 1, NOTHING + 1), -np.inf)
        forward[0, NOTHING] = 0
        for j in range(1, n + 1):
            terms = [np.logaddexp.reduce(forward[i][:, None] + self.moves, axis=0) + scores[i, j] for i in range(max(0, j - MAX_CHUNKS), j) if (i, j) in scores]
            forward[j] = np.logaddexp.reduce(terms, axis=0)
        backward = np.full((n + 1, NOTHING + 1), -np.inf)
        backward[n] = 0
        for i in range(n - 1, -1, -1):
            terms = [np.logaddexp.reduce(self.moves + (scores[i, j] + backward[j])[None], axis=1) for j in range(i + 1, min(n, i + MAX_CHUNKS) + 1) if (i, j) in scores]
            backward[i] = np.logaddexp.reduce(terms, axis=0)
        total = np.logaddexp.reduce(forward[n])
        grad_w, grad_m = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for (i, j), (f, _) in segments.items():
            joint = np.exp(np.minimum(0, forward[i][:, None] + self.moves + (scores[i, j] + backward[j])[None] - total))
            grad_m -= joint
            grad_w -= joint.sum(0)[:, None] * f[None]
        label = NOTHING
        for i, j, y in truth:
            grad_w[y] += segments[i, j][0]
            grad_m[label, y] += 1
            label = y
        self.weights += rate * (grad_w - 1e-3 * self.weights)
        self.moves += rate * (grad_m - 1e-3 * self.moves)

    def best(self, text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (start, end, kind) in code points."""
        n = len(words)
        value = np.full((n + 1, NOTHING + 1), -np.inf)
        value[0, NOTHING] = 0
        first, label = np.zeros((2, n + 1, NOTHING + 1), np.int32)  # of the segment that ends here, and the label before it
        alone: list[float] = []  # what each word scores as nothing
        for j in range(1, n + 1):
            for i in range(j - 1, max(0, j - MAX_CHUNKS) - 1, -1):
                found = self.segment(text, words, i, j)
                if found is None:
                    continue
                s = self.score(j - i, *found)
                if i == j - 1:
                    alone.append(s[NOTHING])
                plain = sum(alone[i:j])
                if found[0][SPELLED]:  # of many words: what their moves cost counts as well
                    plain += (j - i - 1) * self.moves[NOTHING, NOTHING]
                s[:NOTHING][s[:NOTHING] < plain + CLEAR] = -np.inf
                reach = value[i][:, None] + self.moves + s[None]
                came = reach.argmax(0)
                for y in range(NOTHING + 1):
                    if reach[came[y], y] > value[j, y]:
                        value[j, y], first[j, y], label[j, y] = reach[came[y], y], i, came[y]
        out, j, y = [], n, int(value[n].argmax())
        while j > 0:
            i, before = int(first[j, y]), int(label[j, y])
            if y != NOTHING:
                out.append((*_trim(text, words[i][0], words[j - 1][1]), y))
            j, y = i, before
        return out[::-1]


#: of the at sign and of the dots of an address
SPELLINGS = ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" at ", "."))


#: What looks like personal data and is none. Fixed values; ``0`` stands for any digit.
HARMLESS = ("0000-00-00", "0000-00-00 00:00:00", "00:00:00", "00.00.0000 00:00", "00/00/0000", "0000-00-00T00:00:00", "0.00.000", "0 000 000 000",
            "no. 0000000000", "000-00-00000-00-0", "000,000,000.00", "0000000000000", "0000-0000 and 0000", "00 000 000", "000/000/0000", "00 00 00 00 00 00")


def _without_digits(address: str, turn: int) -> str:
    """In every second turn the address with a name of one word and in letters alone, if any are left on both sides: corpora may number all mailboxes."""
    name, _, host = re.sub("[^A-Za-z@.]", "", address).partition("@")
    bare = max(name.split("."), key=len), ".".join(filter(None, host.split(".")))
    return "@".join(bare) if turn % 2 and all(bare) else address


def _rewritten(s: str, kind: int, way: int) -> str | None:
    """Another spelling of a plain span."""
    if kind == 0:
        name, _, host = _without_digits(s, way // len(SPELLINGS)).partition("@")
        at, dot = SPELLINGS[way % len(SPELLINGS)]
        return name + at + host.replace(".", dot)
    if kind == 3:
        rest = re.sub(r"^\+[0-9]{1,3}[\x20.-]*", "", s)
        return rest if re.fullmatch(r"\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}", rest) else None
    if kind == 2:
        digits = "".join(_digits.findall(s))
        return "/".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if len(digits) == 16 else None
    return None


def _harmless(s: str, kind: int, way: int) -> str:
    """What may stand in the place of a span without being personal data."""
    if kind == 0 and way % 3:
        at, dot = SPELLINGS[0] if way % 2 else SPELLINGS[-1]
        words = sorted(BEFORE_AT)
        return words[way % len(words)] + at + _without_digits(s, way // 6).partition("@")[2].replace(".", dot)
    digits = iter(str(7**40 + way * 7**39))
    return "".join(next(digits) if c == "0" else c for c in HARMLESS[way % len(HARMLESS)])


def _truth(text: str, words, spans) -> list[tuple[int, int, int]] | None:
    """The segmentation that the spans give, or None if their borders are inside words."""
    out, i = [], 0
    starts = {_trim(text, a, b)[0]: k for k, (a, b) in enumerate(words)}
    ends = {_trim(text, a, b)[1]: k + 1 for k, (a, b) in enumerate(words)}
    for a, b, kind in spans:
        first, last = starts.get(a), ends.get(b)
        if first is None or last is None or first < i or not 0 < last - first <= MAX_CHUNKS or b - a > MAX_CHARS:
            return None
        out += [(k, k + 1, NOTHING) for k in range(i, first)] + [(first, last, kind)]
        i = last
    return out + [(k, k + 1, NOTHING) for k in range(i, len(words))]


def _unlabelled(segments: dict, truth: list[tuple[int, int, int]]) -> bool:
    """True if a segment is spelled like an address and no pattern could label it: such a window is no example of nothing."""
    return any(f[SPELLED] and not any(a <= i and j <= b for a, b, y in truth if y != NOTHING) for (i, j), (f, _) in segments.items())


VERSIONS = 120  # rewritten and harmless spans of each kind to train on


def _versions(samples: list[str]) -> Iterator[tuple[str, list[tuple[int, int, int]], bool]]:
    """Texts with their spans, and whether a span that is no example of the patterns' was put there.

    Each sample stands as it is. The samples of each kind then take turns, so that rare kinds have as many versions as frequent ones.
    """
    of_kind: list[list[tuple[str, tuple[int, int, int], list]]] = [[] for _ in KINDS]
    for sample in samples:
        spans = base_spans(sample)
        yield sample, spans, False
        for k, span in enumerate(spans):
            if all(other == span or other[0] >= span[1] or other[1] <= span[0] for other in spans):
                of_kind[span[2]].append((sample, span, spans[:k] + spans[k + 1 :]))
    for found in of_kind:
        for way in range(VERSIONS if found else 0):
            sample, (a, b, kind), rest = found[way * 7919 % len(found)]
            for other, is_span in ((_rewritten(sample[a:b], kind, way), True), (_harmless(sample[a:b], kind, way), False)):
                if other is not None:
                    shift = len(other) - (b - a)
                    spans = [(x + shift * (x >= b), y + shift * (x >= b), z) for x, y, z in rest]
                    yield sample[:a] + other + sample[b:], sorted([*spans, *([(a, a + len(other), kind)] if is_span else [])]), True


def fit(samples: list[str]) -> SemiCrf:
    """Train on window texts as they are, and with spans written otherwise or put in the place of others."""
    model, cases = SemiCrf(), []
    for text, found, made in _versions(samples):
        words = [m.span() for m in _word.finditer(text)][:40]
        truth = _truth(text, words, [s for s in found if words and s[1] <= words[-1][1]])
        segments = model.segments(text, words)
        if not made and _unlabelled(segments, truth or []):
            continue
        if words and truth is not None and all((i, j) in segments and (y == NOTHING or segments[i, j][1][y]) for i, j, y in truth):
            cases.append((len(words), segments, truth))
    order = np.random.default_rng(7)
    for turn in range(ROUNDS):
        for k in order.permutation(len(cases)):
            model.likelihood_step(*cases[k], 0.2 / (1 + turn / 2))
    return model


def train(docs: DataFrame, n_windows: int = TRAINING_WINDOWS, text_col: str = "text") -> SemiCrf | None:
    """Fit on at most ``n_windows`` windows, half of them with pattern spans if there are so many: those of smallest hash."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text in batch[text_col]:
                for words in windows(text or ""):
                    piece = text[words[0][0] : words[min(len(words), 2 * AROUND + 2) - 1][1]]
                    if len(piece) <= 8 * MAX_CHARS:
                        rows.add((hashlib.md5(piece.encode()).hexdigest(), bool(base_spans(piece)), piece))
            kept = []
            for labelled in (True, False):  # no task sends more than the sample may hold
                kept += sorted(r for r in rows if r[1] == labelled)[: n_windows // 2]
            yield pd.DataFrame(kept, columns=["place", "labelled", "piece"])

    drawn = docs.select(text_col).mapInPandas(draw, "place string, labelled boolean, piece string")
    place = F.row_number().over(Window.partitionBy("labelled").orderBy("place"))  # Spark cuts each task's rows before it shuffles them
    rows = drawn.dropDuplicates(["place"]).withColumn("n", place).filter(F.col("n") <= n_windows // 2).collect()
    found = [r["piece"] for r in sorted(rows, key=lambda r: (not r["labelled"], r["place"]))]
    return fit(found) if found else None


def _whole_host(text: str, start: int, end: int) -> int:
    """The end of a spelled-out address with all labels that follow."""
    while "@" not in text[start:end] and (more := _more_host(text, end)):
        end = more.end()
    return end


def all_spans(text: str | None, model: SemiCrf | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Pattern spans, and with them the field's spans that touch none of them."""
    base = base_spans(text or "")
    if model is None or not text:
        return base, base
    added: list[tuple[int, int, int]] = []
    near = 0
    for words in windows(text):
        for a, b, kind in model.best(text, words):
            b = _whole_host(text, a, b) if kind == 0 else b
            while near < len(base) and base[near][1] <= a:
                near += 1
            if (not added or added[-1][1] <= a) and all(b <= x or a >= y for x, y, _ in base[near:]):
                added.append((a, b, kind))
    return base, sorted(base + added, key=_place)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame, text_col: str = "text", model: SemiCrf | None = None) -> DataFrame:
    """The rows of ``docs`` with ``base_spans`` and ``pii_spans``: kind, start and end in code points, end exclusive.

    Null and empty texts have no spans. Columns of these names are replaced. Without a model, one is trained on ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col=text_col))
    kind = "array<struct<kind:string,first:int,end:int>>"

    @F.pandas_udf(f"base_spans {kind}, pii_spans {kind}")
    def find(texts: pd.Series) -> pd.DataFrame:
        both = [all_spans(t, shared.value) for t in texts]
        return pd.DataFrame([[[{"kind": KINDS[k], "first": a, "end": b} for a, b, k in spans] for spans in x] for x in both], columns=["base_spans", "pii_spans"], dtype=object)

    kept = docs.drop("base_spans", "pii_spans")
    return kept.withColumn("_found", find(F.col(text_col))).select(*kept.columns, "_found.*")


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_pii(docs.select("doc_id", "text"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base_spans"), 256).alias("base_sha256"), text("pii_spans").alias("spans"))


def _masked(text: str, spans) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["first"], -s["end"])):
        if s["first"] >= at:
            out += [text[at : s["first"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and ``n_chars`` renewed; other texts stay as they are."""
    plain, names = plain_names(docs, "text")
    found = find_pii(plain)

    @F.pandas_udf("string")
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_masked(t, s) if s is not None and len(s) else t for t, s in zip(texts, spans, strict=True)], dtype=object)

    out = found.withColumn("text", mask("text", "pii_spans")).select(*names).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
