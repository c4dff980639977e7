"""Secret scan: base patterns, and a linear-chain conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.common import bounded_batches

# Fixed values of the contract. Case is ignored in ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

# What can be a token of the field: runs of 8 characters or more with a digit, long runs of letters in irregular case, whatever is assigned to a
# name that speaks of secrets or follows "bearer", and the lines of a key block. Prose is outside.
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")
DIGITS, TOKEN_END, WORD, GLUE = re.compile("[0-9]+"), re.compile("[A-Za-z0-9+/_=.-]*"), re.compile(r"[A-Za-z_]+|[^\sA-Za-z_]"), re.compile(r"[\s\"',;:=()\[\]{}<>`|-]*")
SHORTEST = 8
KEYED = re.compile(
    r"""(?<![a-z])(?:pwd|pass(?:word|wd|phrase|code)?|secret|token|cred(?:ential)?s?|auth|(?:access|account|api|auth|client|encryption|private|secret|shared|signing)[-_ ]?(?:key|secret|token)|key)"""
    r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?([^\s"'<>;,]{6,})|(?<![a-z])bearer[\x20\t]+([^\s"'<>;,]{6,})""", re.IGNORECASE | re.ASCII,
)
KEYED_WORDS = ("pwd", "pass", "secret", "token", "cred", "auth", "key", "bearer")
LETTERS = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z+/_=-]{16,}")
SWITCH = re.compile(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])")
BLOCK, BLOCK_LINE = re.compile(r"-----BEGIN [A-Z0-9 ]*-----(.*?)(?:-----END|\Z)", re.DOTALL), re.compile(r"(?m)^[\x20\t]*([A-Za-z0-9+/=]+)[\x20\t\r]*$")
DECODED_AT_ONCE = 4096
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
BUCKETS = 1 << 13
SPAN = "array<struct<kind:string,start:int,end:int,value_start:int>>"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret itself) of the base patterns."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    # A run that is too short holds no shorter run that would be long enough, so the length can stand in the pattern.
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def digit_runs(text: str) -> list[tuple[int, int]]:
    """Runs of token characters, found by their digits, which prose hardly has."""
    found, done = [], 0
    for m in DIGITS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in TOKEN_CHARS:
            start -= 1
        done = TOKEN_END.match(text, m.end()).end()
        end = done
        while end > start and text[end - 1] in ".-=/":  # sentence ends and dashes are no part of the token
            end -= 1
        if end - start >= SHORTEST:
            found.append((start, end))
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens of the field in text order, without overlaps: values of telling names first, then lines of key blocks, then runs by shape."""
    found: list[tuple[int, int]] = []
    lower = text.lower()
    if any(w in lower for w in KEYED_WORDS):
        for m in KEYED.finditer(text):
            start, end = m.span(1) if m[1] else m.span(2)
            end -= len(text[start:end]) - len(text[start:end].rstrip(".:)]}"))
            if end - start >= 6:
                found.append((start, end))
    taken = sorted(found)
    if "-----BEGIN " in text:
        lines = [(block.start(1) + line.start(1), block.start(1) + line.end(1)) for block in BLOCK.finditer(text) for line in BLOCK_LINE.finditer(block[1])]
        taken = free_parts(lines, taken, 1)
    letters = [m.span() for m in LETTERS.finditer(text) if len(SWITCH.findall(m[0])) >= max(4, len(m[0]) // 5)]
    return free_parts(letters, free_parts(digit_runs(text), taken, SHORTEST), 16)


def free_parts(more: list[tuple[int, int]], taken: list[tuple[int, int]], shortest: int) -> list[tuple[int, int]]:
    """`taken` and, of the intervals `more`, the parts of `shortest` characters or more that do not overlap it; both are sorted."""
    found, k = [], 0
    for start, end in more:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        j = k
        while start < end:
            stop = min(end, taken[j][0]) if j < len(taken) else end
            if stop - start >= shortest:
                found.append((start, stop))
            if j == len(taken):
                break
            start, j = max(start, taken[j][1]), j + 1
    return sorted(taken + found)


def file_features(text: str, tokens: int) -> list[str]:
    """What the whole file looks like: share of signs that code has, and how dense such tokens are."""
    size = max(1, len(text))
    code = sum(text.count(c) for c in "={};")
    return [f"file code {min(5, int(200 * code / size))}", f"file dense {min(5, int(2000 * tokens / size))}"]


def token_features(text: str, start: int, end: int, of_file: list[str]) -> list[int]:
    """Hashed shape, neighbouring words and file features of one token."""
    token = text[start:end]
    before = [w.lower() for w in WORD.findall(text[max(0, start - 40) : start])][-8:]
    after = [w.lower() for w in WORD.findall(text[end : end + 16])][:1]
    kinds = [("l", str.islower), ("u", str.isupper), ("d", str.isdigit)]
    has = "".join(k for k, test in kinds if any(map(test, token))) + ("s" if any(c in "+/=" for c in token) else "") + ("_" if "_" in token else "") + ("." if "." in token else "") + ("-" if "-" in token else "")
    has += "x" if any(c in "!@#$%^&*?~" for c in token) else ""
    has += "c" if any(c in "()[]{}" for c in token) else ""
    counts = [token.count(c) for c in set(token)]
    entropy = -sum(n / len(token) * math.log2(n / len(token)) for n in counts)
    runs = len(re.findall("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+", token))
    size = min(10, len(token) // 6)
    digits = min(9, 10 * sum(map(str.isdigit, token)) // len(token))
    words = [w for w in before if w[0].isalpha() or w[0] == "_"]
    signs = [w for w in before[-2:] if not (w[0].isalpha() or w[0] == "_")]
    names = [
        f"has {has}", f"size {size}", f"digits {digits}", f"entropy {int(2 * entropy)}", f"runs {min(8, runs * 6 // len(token))}", f"has {has} size {size}",
        f"hex {set(token) <= set('0123456789abcdef')} {size}", f"start {token[:3].lower()}", f"start {token[:4]}", f"entropy {int(2 * entropy)} size {size}",
        f"word {words[-1] if words else ''}", f"word2 {words[-2] if len(words) > 1 else ''}", f"signs {''.join(signs)}", f"after {after[0] if after else ''}",
        f"word {words[-1] if words else ''} has {has}", *of_file, f"signs {''.join(signs)} digits {digits} entropy {int(entropy)}",
    ]
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


FEATURES = 18


def chains(text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Tokens that only white space and signs part belong to one chain; every other token is outside by the tag dictionary, which
    cuts the field there without changing the best path. Prose is never a token."""
    found: list[list[tuple[int, int]]] = []
    for token in tokens:
        if found and token[0] - found[-1][-1][1] <= 12 and GLUE.fullmatch(text, found[-1][-1][1], token[0]):
            found[-1].append(token)
        else:
            found.append([token])
    return found


def labelled_lines(seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """The labelled table the field is trained on: (text, secret spans), from templates filled by rule, so that no real secret is kept."""
    rng = random.Random(seed)
    letters, small, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    number = lambda n: pick(digits, n)
    word = lambda: "".join(rng.choice(["an", "er", "on", "the", "tion", "st", "ou", "le", "ar", "de", "que", "ung"]) for _ in range(rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 7)))
    mixed = lambda low, high: pick(letters + digits, rng.randint(low, high) - 1) + rng.choice(digits)
    signed = lambda: "".join(rng.sample([mixed(4, 7), rng.choice("!@#$%^&*?"), mixed(3, 6), rng.choice("!@#$%^&*?~"), pick(letters, 2)], 5))
    name = lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 4)))
    secrets = [
        ("aws_secret_access_key = {}", lambda: pick(letters + digits + "+/", 39) + "7"), ("export TOKEN_VALUE='{}'", lambda: mixed(20, 44)),
        ("Authorization: Bearer {}", lambda: mixed(24, 60)), ("auth {}", lambda: "ghp_" + mixed(36, 36)), ("use {} for it", lambda: "sk_live_" + mixed(24, 32)),
        ("hook: {}", lambda: f"xoxb-{number(11)}-{number(12)}-{mixed(24, 24)}"), ("jwt={}", lambda: f"eyJ{mixed(20, 30)}.eyJ{mixed(30, 60)}.{mixed(40, 43)}"),
        ("client_secret: \"{}\"", lambda: mixed(28, 40)), ("private_key={}", lambda: mixed(32, 64)), ("pwd={}", lambda: mixed(10, 18)), ("pass: {}", lambda: mixed(10, 18)),
        ("credentials {}", lambda: mixed(20, 40)), ("AccountKey={}", lambda: pick(letters + digits + "+/", 85) + "4"), ("db_password=\"{}\"", lambda: mixed(10, 24)),
        ("api-key: {}", lambda: pick("0123456789abcdef", 32)), ("token = \"{}\"", lambda: pick("0123456789abcdef", 40)), ("key {}", lambda: "AIza" + mixed(35, 35)),
        ("pwd={}", lambda: "".join(word().capitalize() for _ in range(3)) + "Xy"), ("Authorization: Bearer {}", lambda: pick(letters, rng.randint(20, 40))), ("pass: {}", signed),
        ("DB_PASS={}", signed), ("password: {}", signed), ("aws_secret_access_key = {}", lambda: pick(letters + "+/", 40)), ("passphrase = \"{}\"", lambda: pick(letters, rng.randint(12, 30))),
        ("token: {}", lambda: pick(letters, rng.randint(20, 44))), ("key={}", lambda: pick(letters, rng.randint(24, 44))), ("secret = '{}'", signed), ("the code {}", lambda: pick(letters, rng.randint(32, 48))),
        ("access {}", lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + "7"), ("npm {}", lambda: "npm_" + mixed(36, 36)), ("glpat {}", lambda: "glpat-" + mixed(20, 20)),
    ]
    harmless = [
        lambda: f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", lambda: number(16), lambda: f"{word()}.{number(2)}@mail{number(1)}.example.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        lambda: f"20{number(2)}-{number(2)}-{number(2)}", lambda: f"https://{word()}.example.org/en/{number(5)}.html", lambda: f"{word()}{number(1)}{word()}{word()}", lambda: f"page={number(3)}-{number(6)}",
        lambda: f"version {number(1)}.{number(2)}.{number(4)}", lambda: f"{word()}_{word()}_{number(3)}", lambda: f"{number(2)}:{number(2)} {number(8)}", lambda: f"isbn {number(3)}-{number(1)}-{number(5)}-{number(3)}-{number(1)}",
        lambda: f"GPL-{number(1)}.{number(1)}-or-later", lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: f"{number(4)} {number(4)} {number(4)} {number(4)}", lambda: f"{number(4)}-{number(4)}-{number(4)}-{number(4)}",
        lambda: f"{word().upper()}-{number(4)}", lambda: f"$ {number(3)}.{number(3)}.{number(3)},{number(2)}", lambda: f"img{number(4)}_{word()}.png", lambda: f"{word()}{word()}{word()}{number(1)}",
        lambda: f'id="{word()}-{number(2)}-{word()}-20{number(2)}"', lambda: f"class=\"{word()}-{number(2)} {word()}-{word()}-{number(3)}\"", lambda: f"href=\"#{word()}-{number(1)}-{word()}-{number(4)}\"",
    ]
    # What telling names are also followed by: words, calls, paths and places to fill in.
    told = ["key", "token", "pass", "auth", "secret", "pwd", "credentials", "bearer", "api_key", "password"]
    values = [
        lambda: word() + word(), lambda: f"{word()}{word()}()", lambda: f"{word()}.{word()}{word()}", lambda: f"get{name()}({word()})", lambda: f"<{word()}-{word()}>", lambda: f"${{{word().upper()}_{word().upper()}}}",
        lambda: f"self.{word()}_{word()}", lambda: f"os.environ[{word()}]", lambda: "required", lambda: "optional", lambda: "disabled", lambda: "string", lambda: "********", lambda: f"{word()}/{word()}/{word()}",
        lambda: f"{word()}{word()}{word()}", lambda: f"https://{word()}.example.org/{word()}", lambda: f"{name()}", lambda: "changed", lambda: "undefined",
    ]
    plain = [lambda: f"{rng.choice(told)}{rng.choice([': ', ' = ', '=', ' : '])}{rng.choice(values)()}", lambda: f"bearer {word()}{word()}{word()}", lambda: "".join(name() for _ in range(2)) + "Factory", lambda: "_".join(word().upper() for _ in range(5))]
    lines: list[tuple[str, list[tuple[int, int]]]] = []
    for _ in range(1500):
        form, make = rng.choice(secrets)
        value, head = make(), prose() + rng.choice([" ", "\n", " # "])
        at = len(head) + form.index("{}")
        lines.append((head + form.format(value) + rng.choice([" ", "\n", "; "]) + prose(), [(at, at + len(value))]))
    for _ in range(160):  # a key over several lines: begin, inside, inside ...
        rows = [pick(letters + rng.choice([digits + "+/", "+/"]), 64) for _ in range(rng.randint(2, 6))] + [pick(letters + digits, rng.randint(2, 60)) + rng.choice(["", "=", "=="])]
        head, body = f"-----BEGIN {rng.choice(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----\n", "\n".join(rows)
        lines.append((f"{head}{body}\n-----END PRIVATE KEY-----", [(len(head), len(head) + len(body))]))
    for _ in range(240):  # neighbouring secrets: begin, begin ...
        access, key = "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 15) + "7", pick(letters + digits + "+/", 39) + "7"
        pair = [access, key] if rng.random() < 0.7 else [mixed(20, 40), mixed(20, 40)]
        form = rng.choice(["{},{}", "{} {}", "\"{}\",\"{}\"", "aws_access_key_id={}\naws_secret_access_key={}", "{}, {}"])
        text = f"{prose()}\n{form.format(*pair)}\n{prose()}"
        lines.append((text, [(text.index(x), text.index(x) + len(x)) for x in pair]))
    for _ in range(160):  # a certificate is no secret
        rows = [pick(letters + digits + "+/", 64) for _ in range(rng.randint(2, 6))]
        lines.append(("-----BEGIN CERTIFICATE-----\n" + "\n".join(rows) + "\n-----END CERTIFICATE-----", []))
    for _ in range(1200):
        lines.append((f"{prose()} {rng.choice(plain)()}{rng.choice([' ', '.', ', ', chr(10)])}{prose()}", []))
    for _ in range(2200):
        lines.append((f"{prose()} {rng.choice(harmless)()}{rng.choice([' ', '.', ', ', '%%% ', chr(10)])}{prose()}", []))
    return lines


class Field:
    """Weights of the chain: one row per hashed feature, and scores of neighbouring tags."""

    def __init__(self):
        self.weights = np.zeros((BUCKETS, 3))
        self.steps = np.zeros((3, 3))
        self.steps[OUTSIDE, INSIDE] = -1e3  # a span starts with begin
        self.first = np.array([0.0, -1e3, 0.0])

    @staticmethod
    def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    def fit(self, samples: list[tuple[np.ndarray, list[int]]], rounds: int = 120, rate: float = 0.15, decay: float = 2e-3) -> None:
        """Maximum likelihood by forward-backward over all chains of a length at once, with AdaGrad steps."""
        groups: dict[int, list] = {}
        for features, tags in samples:
            groups.setdefault(len(tags), []).append((features, tags))
        packed = [(np.array([f for f, _ in g]), np.array([t for _, t in g])) for g in groups.values()]
        total, seen_w, seen_s = len(samples), np.full((BUCKETS, 3), 1e-8), np.full((3, 3), 1e-8)
        for _ in range(rounds):
            slope_w, slope_s = -decay * self.weights, -decay * np.where(self.steps < -100, 0, self.steps)
            for x, y in packed:
                n, size = y.shape
                scores = self.weights[x].sum(axis=2)
                ahead, back = np.zeros((n, size, 3)), np.zeros((n, size, 3))
                ahead[:, 0] = scores[:, 0] + self.first
                for k in range(1, size):
                    ahead[:, k] = scores[:, k] + self._log_sum(ahead[:, k - 1, :, None] + self.steps, 1)
                for k in range(size - 2, -1, -1):
                    back[:, k] = self._log_sum(self.steps + (scores[:, k + 1] + back[:, k + 1])[:, None, :], 2)
                whole = self._log_sum(ahead[:, -1], 1)
                miss = np.eye(3)[y] - np.exp(ahead + back - whole[:, None, None])
                for k in range(x.shape[2]):
                    np.add.at(slope_w, x[:, :, k], miss / total)
                for k in range(1, size):
                    pair = ahead[:, k - 1, :, None] + self.steps + (scores[:, k] + back[:, k])[:, None, :] - whole[:, None, None]
                    slope_s += (np.einsum("na,nb->ab", np.eye(3)[y[:, k - 1]], np.eye(3)[y[:, k]]) - np.exp(pair).sum(axis=0)) / total
            seen_w += slope_w**2
            seen_s += slope_s**2
            self.weights += rate * slope_w / np.sqrt(seen_w)
            self.steps += np.where(self.steps < -100, 0, rate * slope_s / np.sqrt(seen_s))

    def decode(self, features: np.ndarray) -> list[int]:
        """The best tags of one chain."""
        return self.best_path(self.weights[features].sum(axis=1))

    def decode_blocks(self, blocks: Iterator[np.ndarray]) -> list[int]:
        """The same for a long chain, whose features come block by block."""
        return self.best_path(np.concatenate([self.weights[x].sum(axis=1) for x in blocks]))

    def best_path(self, scores: np.ndarray) -> list[int]:
        """Viterbi over the scores of each token's tags."""
        best, came = scores[0] + self.first, []
        for row in scores[1:]:
            ways = best[:, None] + self.steps
            came.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        tags = [int(best.argmax())]
        for links in reversed(came):
            tags.append(int(links[tags[-1]]))
        return tags[::-1]


def chain_features(text: str) -> Iterator[tuple[list[tuple[int, int]], Iterator[np.ndarray]]]:
    """Chains of a text, each with its features in blocks, so that a chain of any length holds three numbers a token."""
    tokens = candidates(text)
    of_file = file_features(text, len(tokens)) if tokens else []
    for chain in chains(text, tokens):
        parts = (chain[k : k + DECODED_AT_ONCE] for k in range(0, len(chain), DECODED_AT_ONCE))
        yield chain, (np.array([token_features(text, a, b, of_file) for a, b in part]) for part in parts)


def trained_field(lines: list[tuple[str, list[tuple[int, int]]]] | None = None) -> Field:
    """A field fitted on labelled lines (the built-in table, about 5,500 rows, unless others are given)."""
    samples = []
    for text, spans in labelled_lines() if lines is None else lines:
        for tokens, features in chain_features(text):
            tags, last = [], None
            for start, end in tokens:
                span = next((s for s in spans if start < s[1] and end > s[0]), None)
                tags.append(OUTSIDE if span is None else INSIDE if span == last else BEGIN)
                last = span
            samples.append((np.concatenate(list(features)), tags))
    field = Field()
    field.fit(samples)
    return field


def crf_spans(text: str, field: Field, taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans tagged by the field, less the base spans: tokens that touch none stay, and of a token that does the parts beside it that
    could be tokens themselves."""
    found: list[tuple[int, int, int, int]] = []
    covered = lambda start, end: any(start < t[2] and end > t[0] for t in taken)
    for tokens, blocks in chain_features(text):
        open_span, tagged = None, False
        tags = field.decode(next(blocks)) if len(tokens) <= DECODED_AT_ONCE else field.decode_blocks(blocks)
        for (start, end), tag in [*zip(tokens, tags), ((0, 0), OUTSIDE)]:
            tagged = tag == BEGIN or (tagged and tag == INSIDE)
            free = tagged and not covered(start, end)
            if open_span and (tag != INSIDE or not free):
                found.append((open_span[0], 3, open_span[1], open_span[0]))
                open_span = None
            if tagged and not free:
                marks = sorted((t[0], t[2]) for t in taken if start < t[2] and end > t[0])
                for a, b in zip([start, *(m[1] for m in marks)], [*(m[0] for m in marks), end]):
                    found += [(a + x, 3, a + y, a + x) for x, y in candidates(text[a:b])]
            if free:
                open_span = (open_span[0] if open_span else start, end)
    return found


def scan(text: str, field: Field) -> list[tuple[int, int, int, int]]:
    base = base_spans(text)
    return sorted(base + crf_spans(text, field, base))


def digest(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def _scanned(texts: pa.Array, field: Field) -> pa.Array:
    rows = []
    for text in texts:
        spans = scan(text.as_py() or "", field)
        base = digest([s for s in spans if s[1] < 3])
        rows.append({
            "spans": [{"kind": KINDS[k], "start": a, "end": b, "value_start": v} for a, k, b, v in spans],
            "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "digest": digest(spans),
        })
    return pa.array(rows, pa.struct([
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32())]))),
        ("base_sha256", pa.string()), ("digest", pa.string()),
    ]))


def _redacted(texts: pa.Array, field: Field, mark: str) -> pa.Array:
    rows = []
    for item in texts:
        text = item.as_py()
        if text:
            parts, at = [], 0
            for start, end in sorted((v, b) for _, _, b, v in scan(text, field)):
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            text = "".join([*parts, text[at:]])
        rows.append(text)
    return pa.array(rows, pa.string())


def secret_scan(text: Column | str, field: Field | None = None) -> Column:
    """Struct (spans, base_sha256, digest) of a text column, row-local. spans: kind, start, end and value_start in code points; digest: all
    spans as kind:start:end. Null and empty texts have no spans; repeated rows get equal results; texts of any length are read whole."""
    bounded_batches()
    field = field or trained_field()

    def scanned(texts: pa.Array) -> pa.Array:
        return _scanned(texts, field)

    return F.arrow_udf(scanned, f"spans {SPAN}, base_sha256 string, digest string")(text)


def redact_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[SECRET]", field: Field | None = None) -> DataFrame:
    """`docs` with every secret replaced by `mark`; of an assignment the name stays. `length`, if there is such a column, follows the text
    where it changed. Null texts stay null."""
    bounded_batches()
    field = field or trained_field()

    def redacted(texts: pa.Array) -> pa.Array:
        return _redacted(texts, field, mark)

    found = docs.withColumn("_redacted_text", F.arrow_udf(redacted, "string")(text))
    if length in docs.columns:
        changed = ~F.col(text).eqNullSafe(F.col("_redacted_text"))
        found = found.withColumn(length, F.when(changed, F.length("_redacted_text")).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return found.withColumn(text, F.col("_redacted_text")).select(*docs.columns)
