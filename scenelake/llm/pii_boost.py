"""Personal data by candidate gradient boosting (DataFrame functions only on the main path).

Base spans come from four fixed patterns with checks and always stay. High-recall generators propose further, possibly
overlapping candidates (spelled-out e-mail addresses, national phone numbers, account and identity numbers, IPv6,
keys, tokens, key blocks, passwords that are announced); boosted trees score format and context features, and one threshold per generator, calibrated by isotonic
regression on held-out candidates, selects. Features are of format (characters, groups, turns between digits and letters, different characters,
checksums) and of context (cue words before, what follows). The trees are fitted on the driver on a fixed number of
made-up examples (TRAIN_TEXTS of each template), whose features are computed by the same expressions, and run as CASE
expressions inside the scan's stage: no shuffle, no Python. Candidates may be of any length.

Positions: regexp_extract_all gives the matches and split the text between them, in the same order; running lengths
give code-point offsets. Patterns are written with possessive loops, so long runs neither recurse nor backtrack.

Edge cases: null text counts as empty and has no spans (base_sha256 is that of the empty string); repeated rows are
judged each for itself; an empty table gives an empty result; redact() keeps all columns of its input, also those it
does not know, and leaves a null text null.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import text_or_empty

#: Kinds in the order in which spans of one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
#: Base patterns. The contract's, with possessive loops; a local part is entered at its first character only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generator -> (kind, pattern, cheap test that texts without a match mostly fail).
GENERATORS: dict[str, tuple[str, str, str]] = {
    "spelled": (
        "email",
        r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+(?: ?[(\[{]at[)\]}] ?| at )[A-Za-z0-9-]{2,}+"
        r"(?:(?: ?[(\[{]dot[)\]}] ?| dot )[A-Za-z]{2,}+)++",
        r"(?i)[( \[{]dot[) \]}]",
    ),
    "number": ("phone", r"(?<![A-Za-z0-9.+])\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,}+", "[0-9]"),
    "account": ("id", r"(?i)(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])", "[A-Za-z][0-9]"),
    "lettered": ("id", r"(?<![A-Za-z0-9-])[0-9]{7,9}-?[A-Za-z](?![A-Za-z0-9])", "[0-9]-?[A-Za-z]"),
    "ipv6": (
        "ip",
        r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![A-Za-z0-9:])",
        "[0-9A-Fa-f]:[0-9A-Fa-f]|::",
    ),
    "key": ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+", "[0-9]"),
    "parts": ("secret", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{4,}+)?", "eyJ"),
    "block": ("secret", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*+-----END [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY"),
    "password": (
        "secret",
        r"(?i)(?<=(?:password|passwort|passwd|passcode|contraseña|mot de passe|pwd|pass)[\"']?[ ]{0,1}(?:[:=]|is|ist|es|est)[ ]{0,1}[\"']?)[^\s\"',;<>]{5,}+",
        "(?i)pass|pwd|contrase",
    ),
}
CONTEXT = 32
FEATURES = (
    "len", "digits", "letters", "seps", "opens", "gen_no", "groups", "c_phone", "c_mail", "c_id", "c_secret", "c_noise", "quoted", "ssn",
    "distinct", "spread", "turns", "upper", "luhn", "mod97", "runs_on", "date", "check_letter", "in_url", "marks", "sign",
)
#: Words before a candidate that speak for or against a kind.
CUES = {
    "c_phone": "tel|phone|call|fon|fax|mobil|llama|appel|ruf",
    "c_mail": "mail|contact|write|schreib|correo|courriel",
    "c_id": "ssn|social|iban|account|konto|cuenta|compte|passport|tax",
    "c_secret": "token|key|secret|passw|pwd|api|auth|credential",
    "c_noise": "isbn|order|invoice|page|version|serial|part|total|build|commit|sha|id ",
}
#: The spread is the number of different characters by the length, or by this where the candidate is longer.
SPREAD = 64
#: The letter that follows a number by its rest modulo 23, in Spanish identity numbers: fixed value.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Made-up examples per class and generator that the trees are fitted on.
TRAIN_TEXTS = 60


def _spans(text: Column, pattern: str, generator: str) -> Column:
    """Matches as array<struct<start, end, m, before, after, generator>>, start and end in code points."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start: int, end: int, m: string, before: string, after: string, generator: string>>)")
    start = F.struct(F.lit(0).alias("pos"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["piece"])
        to = at + F.length(x["m"])
        span = F.struct(
            at.alias("start"), to.alias("end"), x["m"].alias("m"), F.lower(F.right(x["piece"], F.lit(CONTEXT))).alias("before"),
            x["after"].alias("after"), F.lit(generator).alias("generator"),
        )
        return F.struct(to.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.transform(
        found, lambda m, i: F.struct(F.get(pieces, i).alias("piece"), m.alias("m"), F.substring(F.get(pieces, i + 1), 1, 1).alias("after"))
    )
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.translate(m, " -().+/", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.least(F.length(d), F.lit(19))), F.lit(0),
        lambda a, k: a + F.when(k % 2 == 1, F.substring(d, k, F.lit(1)).cast("int")).otherwise(
            (F.substring(d, k, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(d, k, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return total % 10 == 0


def _mod97(m: Column) -> Column:
    """Whether an account number's check digits hold (ISO 7064, as in IBAN)."""
    c = F.upper(F.translate(m, " ", ""))
    turned = F.split(F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4)), "")
    code = lambda x: F.ascii(x) - F.when(x <= "9", 48).otherwise(55)
    rest = F.aggregate(turned, F.lit(0), lambda a, x: F.when(x == "", a).otherwise((a * F.when(x <= "9", 10).otherwise(100) + code(x)) % 97))
    return rest == 1


def base_spans(text: Column) -> Column:
    """Base spans, checked, as array<struct<start, kind_no, end, kind>> in contract order."""

    def of(kind: str, pattern: str, may: Column, good) -> Column:
        spans = F.filter(_spans(text, pattern, kind), good)
        out = F.transform(spans, lambda s: _span(s["start"], s["end"], kind))
        return F.when(may, out).otherwise(F.expr("cast(array() as array<struct<start: int, kind_no: int, end: int, kind: string>>)"))

    part_ok = lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255), F.lit(False))
    n_digits = lambda m: F.length(_digits(m))
    has_digit = text.rlike("[0-9]")
    return F.sort_array(F.concat(
        of("email", EMAIL, text.contains("@"), lambda s: F.lit(True)),
        of("ip", IP, has_digit, lambda s: F.forall(F.split(s["m"], r"\."), part_ok)),
        of("card", CARD, has_digit, lambda s: F.when(n_digits(s["m"]).between(14, 19), _luhn(s["m"])).otherwise(False)),
        of("phone", PHONE, text.contains("+"), lambda s: n_digits(s["m"]).between(10, 15)),
    ))


def _span(start: Column, end: Column, kind) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    no = F.array_position(F.array(*map(F.lit, KINDS)), k).cast("int")
    return F.struct(start.alias("start"), no.alias("kind_no"), end.alias("end"), k.alias("kind"))


def candidates(text: Column) -> Column:
    """What all generators propose, with features: array<struct<start, end, kind, generator, features...>>."""
    none = F.expr("cast(array() as array<struct<start: int, end: int, m: string, before: string, after: string, generator: string>>)")
    each = [F.when(text.rlike(test), _spans(text, pattern, name)).otherwise(none) for name, (_, pattern, test) in GENERATORS.items()]
    return F.transform(F.concat(*each), _featured)


def _featured(s: Column) -> Column:
    m, before = s["m"], s["before"]
    n = F.length(m)
    digits = n - F.length(F.translate(m, "0123456789", ""))
    seps = n - F.length(F.translate(m, " -().+/:[]", ""))
    kind = F.lit(None).cast("string")
    number = F.lit(-1)
    for k, (name, (of, _, _)) in enumerate(GENERATORS.items()):
        kind, number = F.when(s["generator"] == name, of).otherwise(kind), F.when(s["generator"] == name, k).otherwise(number)
    distinct = F.size(F.array_distinct(F.split(m, "")))
    ssn = m.rlike(r"^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$")
    # a plain number that is announced as an identity or account number, or has the shape of one, is no phone
    cue = lambda c: before.rlike(CUES[c])
    kind = F.when((s["generator"] == "number") & (m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | (cue("c_id") & ~cue("c_phone"))), "id").otherwise(kind)
    # what has the form and the check digits of an account number is one, whoever proposes it
    account = (s["generator"] == "account") | ((s["generator"] == "key") & m.rlike("(?i)^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"))
    checked = F.when(account, _mod97(m))
    kind = F.when((s["generator"] == "key") & F.coalesce(checked, F.lit(False)), "id").otherwise(kind)
    lettered = s["generator"] == "lettered"
    rest = F.regexp_extract(m, "^([0-9]+)", 1).try_cast("long") % 23
    letter = F.upper(F.right(m, F.lit(1))) == F.substring(F.lit(CHECK_LETTERS), rest.cast("int") + 1, F.lit(1))
    values = {
        "len": n, "digits": digits, "letters": n - digits - seps, "seps": seps, "opens": F.length(m) - F.length(F.translate(m, "([", "")),
        "gen_no": number, "groups": F.size(F.split(m, r"[ \-().+/:\[\]]+")), **{c: before.rlike(cue).cast("int") for c, cue in CUES.items()},
        "quoted": before.rlike(r"[\"'=:]\s*$").cast("int"), "ssn": ssn.cast("int"),
        # structure: how many different characters, in all and against their number; changes between digits and letters
        "distinct": distinct, "spread": distinct / F.least(n, F.lit(SPREAD)),
        "turns": F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "0"), "[A-Za-z]+", "a")),
        "upper": n - F.length(F.translate(m, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        # checksums, and whether a letter or digit follows at once
        "luhn": F.when((s["generator"] == "number") & digits.between(13, 19), _luhn(m).cast("int")).otherwise(-1),
        "mod97": F.coalesce(checked.cast("int"), F.lit(-1)),
        "runs_on": s["after"].rlike("[A-Za-z0-9]").cast("int"),
        "date": m.rlike(r"^(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|^[0-9]{1,2}[-./][0-9]{1,2}[-./](19|20)?[0-9]{2}\b").cast("int"),
        "check_letter": F.when(lettered, F.coalesce(letter, F.lit(False)).cast("int")).otherwise(-1),
        # within a URL or path, marks besides letters and digits, and a known beginning
        "in_url": before.rlike(r"(://|www\.|/)[^\s]*$").cast("int"),
        "marks": n - F.length(F.regexp_replace(m, "[^A-Za-z0-9 -]", "")),
        "sign": m.rlike("^(AKIA|ASIA|ghp_|gho_|sk[_-]|pk[_-]|xox[bp]-|eyJ|-----BEGIN)").cast("int"),
    }
    return F.struct(
        s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), s["generator"].alias("generator"),
        *[values[f].cast("double").alias(f) for f in FEATURES],
    )


#: What stands before a made-up example: people's ways of announcing it, and other uses of numbers and strings.
BEFORE = {
    "phone": ("reach me on", "my number is", "ring", "you can call", "Tel.", "phone:", "Handy", "llámame al", "appelez le", "fax", "text me at", "our hotline", ""),
    "mail": ("write to", "send it to", "I am", "contact", "schreib an", "escribe a", "mail", "drop a line:", ""),
    "id": ("SSN", "social security no.", "IBAN", "please pay into", "Konto", "my account is", "tax number", "passport", "transfer to", ""),
    "password": ("password:", "Password =", "pwd=", "passwd:", "the password is", "Passwort:", "contraseña:", "mot de passe :", 'password="'),
    "secret": ("token =", "API_KEY:", "export SECRET=", "password is", "use the key", "Authorization: Bearer", "aws_access", "client_secret=", "credential"),
    "noise": ("ISBN", "order", "invoice no.", "page", "version", "serial", "part", "total of", "build", "commit", "sha256", "item", "in the year", "on", "see", "id", ""),
}


def _examples(seed: int = 7, n: int = TRAIN_TEXTS, before: dict[str, tuple[str, ...]] = BEFORE) -> list[tuple[int, str, str]]:
    """(label, what it is, text) made up from templates; a text's candidates all carry its label. The same for a seed."""
    r = random.Random(seed)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "th", "ou", "le", "ion", "st"]) for _ in range(r.randint(1, 3)))
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    fill = lambda: " ".join(word() for _ in range(r.randint(2, 6)))
    said = lambda name: r.choice(before[name])

    def iban() -> str:
        land, body = r.choice(["DE", "FR", "ES", "GB", "NL"]), digit(r.choice([14, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        t = f"{land}{check:02d}{body}"
        return t if r.random() < 0.5 else " ".join(t[k : k + 4] for k in range(0, len(t), 4))

    def dni() -> str:
        body = digit(8)
        return f"{body}{r.choice(['', '-'])}{CHECK_LETTERS[int(body) % 23]}"

    def made_word() -> str:
        """As people make passwords: words with digits or marks, capitals within, or letters for digits."""
        return r.choice([
            lambda: f"{word()}{word()}{digit(r.randint(1, 4))}", lambda: f"{word().title()}{word()}{digit(2)}{r.choice('!?#$&*')}", lambda: f"{word()}{digit(1)}{word()}{word()}",
            lambda: f"{word().title()}{digit(1)}{word()}{digit(1)}{word()}{r.choice('&!$')}{digit(1)}", lambda: f"{digit(2)}{word()}{r.choice('_-.')}{word()}{digit(2)}", lambda: mixed(r.randint(8, 15)),
        ])()

    good = [
        ("email", lambda: f"{said('mail')} {word()}.{word()} at {word()}{word()} dot {r.choice(['com', 'org', 'co dot uk', 'info'])}"),
        ("email", lambda: f"{said('mail')} {word()}{digit(2)} (at) {word()}mail [dot] {r.choice(['org', 'net', 'de'])}"),
        ("phone", lambda: f"{said('phone')} {r.choice(['(' + digit(3) + ') ' + digit(3) + '-' + digit(4), '0' + digit(3) + '/' + digit(7), digit(3) + '-' + digit(3) + '-' + digit(4)])}"),
        ("phone", lambda: f"{r.choice([b for b in before['phone'] if b])} {r.choice(['0' + digit(2) + ' ' + digit(4) + ' ' + digit(4), digit(3) + '.' + digit(3) + '.' + digit(4)])}"),
        ("id", lambda: f"{said('id')} {digit(3)}-{digit(2)}-{digit(4)}"),
        ("id", lambda: f"{said('id')} {iban()}"),
        ("id", lambda: f"{r.choice([b for b in before['id'] if b][:2])} {digit(3)} {digit(2)} {digit(4)}"),
        ("id", lambda: f"{r.choice(['DNI', 'NIF', 'identidad', 'my id', ''])} {dni()}"),
        ("id", lambda: f"{said('id')} {iban().lower()}"),
        ("ip", lambda: ":".join(hexes(r.choice([3, 4])) for _ in range(8))),
        ("ip", lambda: f"{r.choice(['from', 'host', 'via', 'ping', 'address', ''])} {r.choice(['fe80', '2001:db8', '2001:' + hexes(3), 'fd' + hexes(2)])}::{':'.join(hexes(r.choice([1, 3, 4])) for _ in range(r.randint(1, 4)))}"),
        ("phone", lambda: f"{r.choice([b for b in before['phone'] if b])} 0{digit(2)} / {digit(3)} {digit(2)} {digit(2)}"),
        ("email", lambda: f"{said('mail')} {word()}{word()} AT {word()}{word()} DOT {r.choice(['com', 'org', 'DE'])}"),
        ("secret", lambda: f"{said('password')}{r.choice(['', ' '])}{made_word()}"),
        ("secret", lambda: f"{said('password')}{r.choice(['', ' '])}{made_word()}"),
        ("secret", lambda: f"{r.choice(['token', 'Bearer', 'jwt =', 'cookie:', ''])} eyJ{mixed(r.randint(17, 40))}.eyJ{mixed(r.randint(20, 80))}.{mixed(43)}"),
        ("secret", lambda: f"{r.choice(['', 'here is the key', 'cat id_rsa'])} -----BEGIN {r.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----\n{mixed(64)}\n{mixed(30)}==\n-----END {r.choice(['', 'RSA ', 'EC '])}PRIVATE KEY-----"),
        ("secret", lambda: f'{said("secret")} "{r.choice([hexes, mixed])(r.choice([24, 32, 40, 64, 160]))}"'),
        ("secret", lambda: f"{said('secret')} {r.choice(['', 'sk_', 'ghp_', 'AKIA'])}{mixed(r.randint(20, 40))}"),
    ]
    bad = [
        ("words", lambda: f"{word()} at {word()} dot {word()} {word()} {word()}" if r.random() < 0.3 else f"{word()}{word()}"),
        ("number", lambda: f"{said('noise')} {digit(r.randint(7, 24))}"),
        ("number", lambda: digit(r.randint(7, 40))),
        ("date", lambda: f"{said('noise')} {r.choice(['19', '20'])}{digit(2)}-{digit(2)}-{digit(2)}"),
        ("date", lambda: f"{digit(2)}.{digit(2)}.{digit(4)} {digit(2)}.{digit(2)}"),
        ("range", lambda: f"{digit(4)} - {digit(4)}"),
        ("code", lambda: f"{upper(2)}{digit(2)} {upper(4)} {upper(4)}"),
        ("word", lambda: "".join(word() for _ in range(12))[:60].ljust(20, "e")),
        ("hash", lambda: f"{r.choice(['commit', 'sha', 'sha256', 'build', 'version'])} {hexes(40)}"),
        ("slug", lambda: f"{word()}-{word()}{word()}-{digit(4)}{word()}{word()}{word()}"),
        ("time", lambda: ":".join(digit(2) for _ in range(4))),
        ("scope", lambda: f"{r.choice(['std', 'ab', 'cafe', 'dead', 'face', word()])}::{r.choice(['be', 'add', 'beef', 'fade', 'a', word()])}"),
        ("colons", lambda: f"{word()} {r.choice(['::', ' :: ', 'x::', '::='])} {word()}"),
        ("slug", lambda: f"https://{word()}.{word()}/{'-'.join(word() for _ in range(r.randint(3, 7)))}-{digit(4)}-{digit(2)}-{digit(2)}-{word()}"),
        ("slug", lambda: f"{word()}.com/{word()}/{'_'.join(word() for _ in range(r.randint(4, 8)))}{digit(r.randint(1, 5))}.html"),
        ("rule", lambda: f"{r.choice(['password', 'Passwort', 'pwd', 'contraseña'])}{r.choice([':', ' is', '='])} {r.choice(['required', 'incorrect', 'wrong', 'needed', 'erforderlich', 'changed', 'expired', 'protected', 'optional', 'hidden', 'forgotten', 'stored', 'string', 'empty', 'false', 'correct.', 'unknown'])}"),
        ("name", lambda: f"{r.choice(['set', 'export', 'the variable', 'in', 'see', 'use'])} {'_'.join(upper(r.randint(2, 7)) for _ in range(r.randint(3, 5)))}{r.choice(['=', ' =', ' first', ''])}"),
        ("measure", lambda: f"{digit(r.randint(7, 9))}{r.choice('kmgbsxhdc')}"),
    ]
    return [(label, kind, f"{fill()} {make()} {fill()}") for label, kinds in ((1, good), (0, bad)) for kind, make in kinds for _ in range(n)]


_FITTED: list[tuple[boosting.Boosted, dict[str, float]]] = []


def _fit(spark: SparkSession) -> tuple[boosting.Boosted, dict[str, float]]:
    doc = json.dumps([{"label": y, "text": t, "fold": k % 3} for k, (y, _, t) in enumerate(_examples())])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(doc), "array<struct<label: int, text: string, fold: int>>")))
    got = rows.select("label", "fold", F.explode(candidates(F.col("text"))).alias("c")).select("label", "fold", "c.generator", *[f"c.{f}" for f in FEATURES])
    data = [tuple(x) for x in got.collect()]  # at most a few candidates for each made-up text
    y, fold = np.array([d[0] for d in data]), np.array([d[1] for d in data])
    name, x = np.array([d[2] for d in data]), np.array([d[3:] for d in data], dtype=float)
    names = np.array([list(GENERATORS).index(n) for n in name])
    model = boosting.fit(x[fold != 0], y[fold != 0], rounds=24, depth=3, rate=0.4, least=5)
    raw = model.raw(x)
    cut = {}
    for k, g in enumerate(GENERATORS):
        held = (fold == 0) & (names == k)
        kx, kp = boosting.isotonic(raw[held], y[held])
        sure = kx[kp >= 0.9]
        cut[g] = float(sure.min()) if len(sure) else float("inf")
    return model, cut


def fitted(spark: SparkSession) -> tuple[boosting.Boosted, dict[str, float]]:
    """The trees and the raw-score threshold of each generator: the least score of calibrated precision 0.9."""
    if not _FITTED:  # the same for every session: the examples are fixed
        _FITTED.append(_fit(spark))
    return _FITTED[0]


def _selected(spark: SparkSession, found: Column) -> Column:
    """Candidates whose calibrated score selects them: array<struct<start, kind_no, end, kind, score>>."""
    model, cut = fitted(spark)

    def scored(c: Column) -> Column:
        raw = F.lit(float(model.base))
        for tree in model.trees:
            raw = raw + _tree(tree, 0, c)
        return raw

    def least(c: Column) -> Column:
        out = F.lit(float("inf"))
        for g, v in cut.items():
            out = F.when(c["generator"] == g, v).otherwise(out)
        return out

    picked = F.transform(found, lambda c: F.struct(c.alias("c"), scored(c).alias("score")))
    picked = F.filter(picked, lambda x: x["score"] >= least(x["c"]))
    return F.transform(picked, lambda x: F.struct(_span(x["c"]["start"], x["c"]["end"], x["c"]["kind"]).alias("s"), x["score"].alias("score")))


def _tree(tree, k: int, c: Column) -> Column:
    feature, cut, left, right, value = tree
    if feature[k] < 0:
        return F.lit(float(value[k]))
    return F.when(c[FEATURES[feature[k]]] <= float(cut[k]), _tree(tree, left[k], c)).otherwise(_tree(tree, right[k], c))


def _merged(base: Column, extra: Column) -> Column:
    """Base spans and those extra ones that overlap none of them; of overlapping extra ones the wider of a kind stays, or
    else the better score.

    Two sweeps over the spans by start: forward against the ends of base spans, backward against their starts.
    """
    all_ = F.concat(
        F.transform(base, lambda b: F.struct(b.alias("s"), F.lit(float("inf")).alias("score"))), extra
    )
    none = F.expr("cast(array() as array<struct<s: struct<start: int, kind_no: int, end: int, kind: string>, score: double>>)")
    is_base = lambda x: x["score"] == float("inf")

    def forward(acc: Column, x: Column) -> Column:
        keep = is_base(x) | (x["s"]["start"] >= acc["edge"])
        return F.struct(
            F.when(is_base(x), F.greatest(acc["edge"], x["s"]["end"])).otherwise(acc["edge"]).alias("edge"),
            F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        )

    def backward(acc: Column, x: Column) -> Column:
        keep = is_base(x) | (x["s"]["end"] <= acc["edge"])
        return F.struct(
            F.when(is_base(x), F.least(acc["edge"], x["s"]["start"])).otherwise(acc["edge"]).alias("edge"),
            F.when(keep, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
        )

    def greedy(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        clash = ~is_base(x) & F.coalesce(~is_base(last) & (last["s"]["end"] > x["s"]["start"]), F.lit(False))
        # of one kind the wider stays, else the better score
        same = x["s"]["kind"] == last["s"]["kind"]
        inside = F.coalesce(same & (x["s"]["end"] <= last["s"]["end"]) & (x["s"]["start"] > last["s"]["start"]), F.lit(False))
        wider = F.coalesce(same & (x["s"]["end"] > last["s"]["end"]) & (x["s"]["start"] <= last["s"]["start"]), F.lit(False))
        better = wider | (~inside & F.coalesce(x["score"] > last["score"], F.lit(True)))
        return F.when(clash & better, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    ahead = F.aggregate(F.sort_array(all_), F.struct(F.lit(0).alias("edge"), none.alias("out")), forward, lambda a: a["out"])
    back = F.aggregate(F.reverse(ahead), F.struct(F.lit(2**31 - 1).alias("edge"), none.alias("out")), backward, lambda a: a["out"])
    kept = F.aggregate(F.reverse(back), none, greedy)
    return F.transform(kept, lambda x: x["s"])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text", prefix: str = "__pii_") -> DataFrame:
    """docs with the base spans and all spans as two array columns, named after the prefix."""
    spark, p = docs.sparkSession, prefix
    t = F.col(f"`{text}`")
    out = docs.withColumns({f"{p}base": base_spans(F.coalesce(t, F.lit(""))), f"{p}found": candidates(F.coalesce(t, F.lit("")))})
    out = out.withColumn(f"{p}extra", _selected(spark, F.col(f"{p}found"))).drop(f"{p}found")
    return out.withColumn(
        f"{p}spans", F.when(F.size(f"{p}extra") == 0, F.col(f"{p}base")).otherwise(_merged(F.col(f"{p}base"), F.col(f"{p}extra")))
    ).drop(f"{p}extra")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of docs."""
    d = with_spans(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text")))
    count = lambda k: F.size(F.filter("__pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select(
        "doc_id", *map(count, KINDS[:4]), F.sha2(_listed(F.col("__pii_base")), 256).alias("base_sha256"), _listed(F.col("__pii_spans")).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    d = with_spans(docs, text)
    t = F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["pos"]
        bit = F.concat(acc["out"], F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(new, bit).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(t, acc["pos"] + 1, F.length(t)))
    clean = F.when(F.size("__pii_spans") == 0, t).otherwise(F.aggregate("__pii_spans", start, step, rest))
    return d.withColumn("__pii_text", clean).select(*[F.col("__pii_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
