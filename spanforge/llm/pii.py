"""Operator 6: personal data, by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field then labels the other tokens that could
be personal data. Its potentials are learned from counts over the whole corpus,
with the matched mentions as labels:

* of one token: how often mentions of its shape, once punctuation is gone, and
  after the word before it, have each label, and how rarely a mention of that
  label comes in a form that no pattern matches: of all mentions, and, for
  tokens that share a key with a matched one, of the repeated ones;
* of neighbouring tokens (chain), and of distant tokens of a document whose
  digits or letters are the same or alike (skip): how much more often than by
  chance such tokens have one label.

Few corpora write a mention twice in different forms, and none says which of the
forms that no pattern matches are personal. So the skip potentials are learned
from the matched mentions as they would be re-spelled: without their punctuation
(all kinds), and a phone without its country code. A re-spelled mention agrees
with itself, and disagrees with what else in its document has the same key and
another label.

Loopy message passing then gives each token's marginal. So a mention in full
form lends its label to its other forms as far as the counts speak for that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import fresh, in_small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits, so the look-behind changes no match and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A token with one of these could be a mention.
SIGN = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")
SPACE = re.compile(r"\s")
AT_DOT = re.compile(r" ?[\[(](at|AT|dot|DOT)[\])] ?")
SPELLED = ("(at)", "[at]", "(AT)", "[AT]", "(dot)", "[dot]", "(DOT)", "[DOT]")
#: A token of digits and what stands between them.
NUMBER = re.compile(r"\+?[0-9().\-/]*[0-9][0-9().\-/]*")
#: Sorts of links: neighbours, and mentions with the same key, the same last or first digits, the same name before the @.
LINKS = ("chain", "same", "tail", "head", "name")
#: Keys that re-spelled mentions keep, by label: all digits or letters; of phones, without a country code, the last digits.
RESPELLED = {"same": (1, 2, 3, 4), "tail": (4,)}
#: Words before a mention are told by so many hashes.
CONTEXTS = 256
#: Smoothing: of shapes, of contexts, and the unmatched tokens of a shape that count as seen without a label.
SHAPE_PRIOR, CONTEXT_PRIOR, NONE_PRIOR = 0.5, 4.0, 10.0
ROUNDS = 200
#: (start, end, label or 0 where no pattern matches, keys by sort of link, shape, context)
Mention = tuple[int, int, int, dict[str, str], str, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        d = re.sub(r"[ -]", "", m[0])
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _bare(mention: str) -> str:
    """The mention with its spelled-out signs as signs."""
    return AT_DOT.sub(lambda m: "@" if m[1] in ("at", "AT") else ".", mention)


def _keys(mention: str) -> dict[str, str]:
    """What other forms of a mention share with it: all digits or letters, or the last, the first, or the name of an address."""
    bare = _bare(mention)
    if "@" in bare:
        plain = re.sub(r"[^a-z0-9]", "", bare.lower())
        name = re.sub(r"[^a-z0-9]", "", bare.split("@")[0].lower())
        return ({"same": plain} if plain else {}) | ({"name": name} if len(name) >= 5 else {})
    digits = re.sub(r"[^0-9]", "", bare)
    if len(digits) < 7 or re.search(r"[A-Za-z]", bare):
        return {}
    return {"same": digits, "tail": digits[-7:]} | ({"head": digits[:7]} if len(digits) >= 9 else {})


def _shape(mention: str) -> str:
    """What is left of a mention without punctuation: an address with a domain or not, or how many digits, and whether they pass Luhn."""
    bare = _bare(mention)
    if "@" in bare:
        return "address" if re.search(r"[^@]@[^@]*\.", bare) else "handle"
    digits = re.sub(r"[^0-9]", "", bare)
    return f"{min(len(digits), 20)}{'v' if 13 <= len(digits) <= 19 and _luhn(digits) else ''}"


def _context(text: str, at: int) -> int:
    """A hash of the word before a place."""
    words = text[max(0, at - 40) : at].split()
    return zlib.crc32(words[-1].lower().encode("utf-8", "surrogatepass")) % CONTEXTS if words else 0


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Where the tokens between white space are that have a sign; spelled-out signs join the words beside them."""
    end = 0
    while m := SIGN.search(text, end):
        a = m.start()
        if text[a] in "[(" and a - 1 > end and text[a - 1] == " ":  # the sign begins a token
            a -= 1
        while a > end and not text[a - 1].isspace():
            a -= 1
        at = m.end()
        while True:
            stop = SPACE.search(text, at)
            end = stop.start() if stop else len(text)
            if text.startswith(SPELLED, end + 1) and text.startswith(" ", end):
                at = end + 1
            elif text.startswith(" ", end) and text.endswith(SPELLED, m.start(), end) and end + 1 < len(text):
                at = end + 1
            else:
                break
        yield a, end


def _joined_numbers(text: str, tokens: list[tuple[int, int]], known: set[str]) -> Iterator[tuple[int, int]]:
    """The tokens; numbers in a row, a space apart, whose digits together are known are one token."""
    digits = [re.sub(r"[^0-9]", "", text[a:b]) if NUMBER.fullmatch(text, a, b) else "" for a, b in tokens]
    longest, i = max(map(len, known)), 0
    while i < len(tokens):
        d, j, last = digits[i], i, i
        while d and d not in known and len(d) < longest and j + 1 < len(tokens) and digits[j + 1] and tokens[j + 1][0] == tokens[j][1] + 1 and text[tokens[j][1]] == " ":
            j += 1
            d += digits[j]
            if d in known:
                last = j
        yield tokens[i][0], tokens[last][1]
        i = last + 1


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Mention]:
    """By start: base spans, and the tokens that overlap none and have a key."""

    def mention(a: int, b: int, label: int) -> Mention:
        return a, b, label, _keys(text[a:b]), _shape(text[a:b]), _context(text, a)

    out = [mention(a, b, 1 + k) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    at, upto, free = 0, -1, []
    for a, b in _tokens(text):
        while at < len(taken) and taken[at][0] < b:
            upto = max(upto, taken[at][1])
            at += 1
        if upto > a:
            continue
        while a < b and text[a] in "\"'<([{,;:":
            a += 1
        while b > a and text[b - 1] in "\"'>)]},;:.!?":
            b -= 1
        free.append((a, b))
    known = {m[3]["same"] for m in out if m[2] > 1 and "same" in m[3]}
    for a, b in _joined_numbers(text, free, known) if known else free:
        if (m := mention(a, b, 0))[3]:
            out.append(m)
    return sorted(out, key=lambda m: m[:3])


def links(nodes: list[Mention]) -> list[tuple[int, int, str]]:
    """(i, j, sort): neighbours, and each mention with the next of its key and with its key's first matched one."""
    out = [(i, i + 1, "chain") for i in range(len(nodes) - 1)]
    groups: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, m in enumerate(nodes):
        for sort, key in m[3].items():
            groups[sort, key].append(i)
    met = set()
    for sort in LINKS[1:]:
        for (s, _), same in groups.items():
            if s != sort or len(same) < 2:
                continue
            full = next((i for i in same if nodes[i][2]), None)
            pairs = list(zip(same, same[1:], strict=False)) + [(min(full, j), max(full, j)) for j in same if full is not None and not nodes[j][2]]
            out += [(i, j, sort) for i, j in sorted(set(pairs) - met)]  # the closest sort of link counts
            met.update(pairs)
    return out


def counts(text: str) -> Counter:
    """What one document adds to the counts behind the potentials.

    Tokens that share a key with a matched mention may be personal data that no
    pattern matches: they aren't taken for anything, but counted as "unmatched".
    "repeated" counts the matched mentions after the first of their key and label.
    """
    c: Counter = Counter()
    base = base_spans(text)
    nodes = mentions(text, base)
    full = {(s, k): m[2] for m in nodes if m[2] for s, k in m[3].items()}
    labels: dict[tuple[str, str], set[int]] = defaultdict(set)
    for _, _, label, keys, _, _ in nodes:
        if label:
            for x in keys.items():
                if x[0] == "same" and label in labels[x]:
                    c["repeated", "", label] += 1
                labels[x].add(label)
    for _, _, label, keys, _, _ in nodes:
        for x in keys.items():
            if label in RESPELLED.get(x[0], ()):
                c["link", x[0], 1] += 1
                c["link", x[0], 0] += len(labels[x]) > 1
    known: list[int | None] = []
    for _, _, label, keys, shape, context in nodes:
        of = 0 if label else next((full[x] for x in keys.items() if x in full), 0)
        known.append(None if of else label)
        if of:
            c["unmatched", "", of] += 1
        else:
            c["shape", shape, label] += 1
            c["context", str(context), label] += 1
    for i, j, sort in links(nodes):
        if known[i] is not None and known[j] is not None:
            c["link", sort, int(known[i] == known[j])] += 1
    return +c


def marginals(local: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Log marginals by loopy message passing, exact on trees.

    local: logs by node and label. edges: (i, j, w), a potential of w where the
    labels of i and j agree and 0 where not.
    """
    belief = local
    if edges:
        a = np.array([e[0] for e in edges] + [e[1] for e in edges])
        b = np.array([e[1] for e in edges] + [e[0] for e in edges])
        w = np.array([e[2] for e in edges] * 2)
        n = len(edges)
        back = np.r_[np.arange(n, 2 * n), np.arange(n)]
        messages = np.zeros((2 * n, local.shape[1]))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, b, messages)
            out = belief[a] - messages[back]
            out -= out.max(axis=1, keepdims=True)
            e = np.exp(out)
            new = np.log(e.sum(axis=1, keepdims=True) + e * np.expm1(w)[:, None])
            new -= new.max(axis=1, keepdims=True)
            done = np.abs(new - messages).max() < 1e-6
            messages = 0.3 * messages + 0.7 * new
            if done:
                break
        belief = local.copy()
        np.add.at(belief, b, messages)
    belief = belief - belief.max(axis=1, keepdims=True)
    return belief - np.log(np.exp(belief).sum(axis=1, keepdims=True))


class Field:
    """Potentials in logs, from the counts of all documents: (what, key, label or agreement) -> how often."""

    def __init__(self, seen: dict[tuple[str, str, int], int]):
        n = np.zeros(len(LABELS))
        self.shapes: dict[str, np.ndarray] = {}
        contexts = np.full((CONTEXTS, len(LABELS)), CONTEXT_PRIOR)
        unmatched, repeated, agree = np.ones(len(LABELS)), np.ones(len(LABELS)), {s: [0, 0] for s in LINKS}
        for (what, key, k), c in seen.items():
            if what == "shape":
                self.shapes.setdefault(key, np.full(len(LABELS), SHAPE_PRIOR))[k] += c
                n[k] += c
            elif what == "context":
                contexts[int(key), k] += c
            elif what == "unmatched":
                unmatched[k] += c
            elif what == "repeated":
                repeated[k] += c
            else:
                agree[key][k] += c
        self.context = np.log(contexts / contexts.sum(axis=0))
        # of mentions of each label, how many come in a form that no pattern matches
        self.form = np.log(unmatched / (n + unmatched + 1))
        # and of those that their document has before or after in full
        self.again = np.log(unmatched / (repeated + unmatched))
        self.form[0] = self.again[0] = 0.0
        # that two tokens agree by chance
        share = (n + 1) / (n + 1).sum()
        chance = float((share**2).sum())
        odds = lambda p: np.log(p / (1 - p))
        self.weight = {s: float(odds((a + 1) / (a + d + 2)) - odds(chance)) if a + d else 0.0 for s, (d, a) in agree.items()}

    def local(self, m: Mention, again: set[int]) -> np.ndarray:
        """The logs of one token's potential; a matched mention has its label. ``again``: labels of matched ones that keep a key of it when re-spelled."""
        if m[2]:
            out = np.full(len(LABELS), -40.0)
            out[m[2]] = 0.0
            return out
        shape = self.shapes.get(m[4], np.full(len(LABELS), SHAPE_PRIOR)).copy()
        shape[0] += NONE_PRIOR
        form = np.where([k in again for k in range(len(LABELS))], self.again, self.form)
        return np.log(shape) + form + self.context[m[5]]

    def label(self, nodes: list[Mention]) -> list[int]:
        """The label of the largest marginal of each mention; matched ones keep theirs."""
        full: dict[tuple[str, str], set[int]] = defaultdict(set)
        for m in nodes:
            for x in m[3].items():
                if m[2] in RESPELLED.get(x[0], ()):
                    full[x].add(m[2])
        again = [set().union(*(full[x] for x in m[3].items() if x in full)) for m in nodes]
        found = marginals(np.array([self.local(m, of) for m, of in zip(nodes, again, strict=True)]), [(i, j, self.weight[s]) for i, j, s in links(nodes)])
        return [m[2] or int(k) for m, k in zip(nodes, found.argmax(axis=1), strict=True)]


def find(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each by kind and start."""
    text = text or ""
    base = base_spans(text)
    nodes = mentions(text, base)
    if len(nodes) == len(base):
        return base, base
    more = [(k - 1, m[0], m[1]) for m, k in zip(nodes, field.label(nodes), strict=True) if k and not m[2]]
    return base, sorted(base + more)


def learn(docs: DataFrame) -> Field:
    """Potentials from counts over every document; one row for each shape or context and label reaches the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                if t:
                    total.update(counts(t))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["what", "key", "label", "n"])

    counted = docs.select("text").mapInPandas(run, "what string, key string, label int, n long")
    rows = counted.groupBy("what", "key", "label").agg(F.sum("n").alias("n")).collect()
    return Field({(r["what"], r["key"], r["label"]): r["n"] for r in rows})


def _masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    end, parts = 0, []
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if b > end:
            parts += [text[end : max(a, end)], f"<{KINDS[k].upper()}>" if a >= end else ""]
            end = b
    return "".join(parts) + text[end:]


RESULTS = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")


def _scanned(docs: DataFrame, name: str, masked: bool) -> DataFrame:
    """``docs`` with a column of that name: the results, and the masked text, or null where it isn't asked for or nothing changes."""
    field = in_small_batches(docs).sparkSession.sparkContext.broadcast(learn(docs))  # under a hundred shapes, and CONTEXTS rows
    kinds = ", ".join(f"n_{k}: long" for k in KINDS)

    @F.pandas_udf(f"struct<{kinds}, base_sha256: string, spans: string, n_added: long, masked: string>")
    def found(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            base, every = find(t, field.value)
            n = Counter(k for k, _, _ in base)
            changed = _masked(t, every) if masked and every else None
            out.append((*(n[k] for k in range(len(KINDS))), sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), changed))
        return pd.DataFrame(out, columns=[*RESULTS, "masked"])

    return docs.withColumn(name, found("text"))


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` and n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind and start.
    The field only adds spans; base spans stay.

    Defined cases: a null or empty text has no spans, and base_sha256 is that of
    the empty string. Repeated rows get equal results. Columns named like a
    result are replaced by it; no column but text is read. An empty table gives
    no rows.
    """
    docs = docs.drop(*RESULTS)
    (name,) = fresh(docs, "found")
    return _scanned(docs, name, masked=False).withColumns({c: F.col(name)[c] for c in RESULTS}).drop(name)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind, as in ``<EMAIL>``; n_chars follows where there is one.

    Spans that overlap become one, named by the first. Defined cases: a null or
    empty text, and one without spans, stays as it is, n_chars included. Columns
    stay as they are, whatever their names; rows that repeat stay repeated. An
    empty table gives no rows.
    """
    (name,) = fresh(docs, "found")
    new = F.col(name)["masked"]
    out = _scanned(docs, name, masked=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(new.isNotNull(), F.length(new).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce(new, "text")).select(*docs.columns)
