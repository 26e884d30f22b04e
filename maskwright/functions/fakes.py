"""Stand-ins that keep a value's format: pure functions of (secret key, kind, original).

Randomness is a SHA-256 counter stream, so the same original gets the same stand-in under retries, speculation
and repartitioning, in every table and run that shares the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fpe import fpe_numeric
from .scalar import bound, digits, iban_check_digits, luhn_digit

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM, ALNUM_UPPER, B62, HEX = LOWER + DIGITS, UPPER + DIGITS, UPPER + LOWER + DIGITS, "0123456789abcdef"
DOMAINS = ("example.com", "example.org", "example.net")
TEST_NETS = ("192.0.2.", "198.51.100.", "203.0.113.")
AWS_PREFIXES = ("AKIA", "ASIA", "AROA", "AGPA", "AIDA", "AIPA", "ANPA", "ANVA")
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
#: Length of an account number by country.
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21,
    "CY": 28, "CZ": 24, "DK": 18, "DO": 28, "EE": 20, "FO": 18, "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23,
    "GR": 27, "GL": 18, "GT": 28, "HU": 28, "IS": 26, "IE": 22, "IL": 23, "IT": 27, "JO": 30, "KZ": 20, "KW": 30,
    "LV": 21, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "MK": 19, "MT": 31, "MR": 27, "MU": 30, "MD": 24, "MC": 27,
    "ME": 22, "NL": 18, "NO": 15, "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "SM": 27, "SA": 24,
    "RS": 22, "SK": 24, "SI": 19, "ES": 24, "SE": 24, "CH": 21, "TN": 24, "TR": 26, "AE": 23, "GB": 22, "VG": 24,
}


class Stream:
    """Bytes of sha256(key | kind | original : block), two hex digits each."""

    def __init__(self, key: str, kind: str, original: Column):
        self.seed = F.concat(F.lit(f"{key}|{kind}|"), original)

    def blocks(self, n: Column | int, salt: str = "") -> Column:
        """The stream in blocks of 32 bytes, as many as n bytes need."""
        last = F.ceil(F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(1)) / 32).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.sha2(F.concat(self.seed, F.lit(f":{salt}:"), k.cast("string")).cast("binary"), 256))

    def hex(self, n: Column | int, salt: str = "") -> Column:
        return F.array_join(self.blocks(n, salt), "")

    @staticmethod
    def byte(stream: Column, i: Column) -> Column:
        return F.conv(F.substr(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")

    @staticmethod
    def _inside(n: Column, k: Column) -> Column:
        """Places in block k of n characters."""
        return F.sequence(F.lit(0), F.least(F.greatest(n, F.lit(1)) - 1 - 32 * k, F.lit(31)).cast("int"))

    def chars(self, n: Column | int, alphabet: str | Column, salt: str = "") -> Column:
        """n characters of the alphabet, drawn block by block: a place in a long string is found by counting from its start."""
        n = F.lit(n) if isinstance(n, int) else n
        letters = F.lit(alphabet) if isinstance(alphabet, str) else alphabet
        one = lambda block, j: F.substr(letters, self.byte(block, j) % F.char_length(letters) + 1, F.lit(1))
        drawn = F.transform(self.blocks(n, salt), lambda block, k: F.array_join(F.transform(self._inside(n, k), lambda j: one(block, j)), ""))
        return F.when(n > 0, F.array_join(drawn, "")).otherwise("")

    def number(self, low: int, high: int, salt: str = "n") -> Column:
        """low <= number < high, from the first eight hex digits."""
        return F.conv(F.substr(self.hex(1, salt), F.lit(1), F.lit(8)), 16, 10).cast("long") % (high - low) + low

    def mapped(self, original: Column, pattern: str, alphabet: str | Column) -> Column:
        """The characters that match pattern replaced, all others kept in place."""
        letters = F.lit(alphabet) if isinstance(alphabet, str) else alphabet
        n = F.char_length(original)

        def part(block, k):
            def one(piece, j):
                c = F.substr(piece, j + 1, F.lit(1))
                return F.when(c.rlike(pattern), F.substr(letters, self.byte(block, j) % F.char_length(letters) + 1, F.lit(1))).otherwise(c)

            return bound(F.substr(original, 32 * k + 1, F.lit(32)), lambda piece: F.array_join(F.transform(self._inside(n, k), lambda j: one(piece, j)), ""))

        return F.when(n > 0, F.array_join(F.transform(self.blocks(n), part), "")).otherwise("")


def pick(options, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def email(key: str, c: Column) -> Column:
    s = Stream(key, "email", c)
    size = F.least(F.greatest(F.octet_length(F.substring_index(c, "@", 1)), F.lit(5)), F.lit(24))
    return F.concat(s.chars(size, ALNUM), F.lit("@"), pick(DOMAINS, s.number(0, 3)))


def phone(key: str, c: Column) -> Column:
    return F.when(c == "", "+1-555-010-0000").otherwise(Stream(key, "phone", c).mapped(c, "[0-9]", DIGITS))


def ssn(key: str, c: Column) -> Column:
    s = Stream(key, "ssn", c)
    pad = lambda n, w: F.lpad(n.cast("string"), w, "0")
    return F.concat_ws("-", pad(s.number(900, 1000, "a"), 3), pad(s.number(1, 66, "g"), 2), pad(s.number(1, 10000, "s"), 4))


def ipv4(key: str, c: Column) -> Column:
    s = Stream(key, "ipv4", c)
    return F.concat(pick(TEST_NETS, s.number(0, 3, "net")), s.number(1, 255, "host").cast("string"))


def uuid(key: str, c: Column) -> Column:
    """Version 4 layout."""
    h = Stream(key, "uuid", c).hex(1)
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1, F.lit(1))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def iban(key: str, c: Column) -> Column:
    s = Stream(key, "iban", c)
    country = F.when(c.rlike("^[A-Z]{2}"), F.substr(c, F.lit(1), F.lit(2))).otherwise("GB")
    table = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    size = F.coalesce(F.try_element_at(table, country), F.least(F.greatest(F.octet_length(c), F.lit(15)), F.lit(34)))
    bban = s.chars(size - 4, ALNUM_UPPER)
    return F.concat(country, F.lpad(iban_check_digits(country, bban).cast("string"), 2, "0"), bban)


def _first_prefix(c: Column, prefixes, default: str) -> Column:
    return F.coalesce(*[F.when(c.startswith(p), F.lit(p)) for p in prefixes], F.lit(default))


def aws_key(key: str, c: Column) -> Column:
    prefix = _first_prefix(c, (*AWS_PREFIXES, "A3T"), "AKIA")
    return F.concat(prefix, Stream(key, "aws", c).chars(20 - F.length(prefix), ALNUM_UPPER))


def github_pat(key: str, c: Column) -> Column:
    s = Stream(key, "github", c)
    fine = F.concat(F.lit("github_pat_"), s.chars(22, B62, "a"), F.lit("_"), s.chars(82, B62, "b"))
    return F.when(c.startswith("github_pat_"), fine).otherwise(F.concat(_first_prefix(c, GITHUB_PREFIXES, "ghp_"), s.chars(36, B62)))


def _base64url(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(c.cast("binary")), "+/", "-_"), "[=\r\n]", "")


def jwt(key: str, c: Column, issued_at: int = 1_700_000_000) -> Column:
    payload = F.concat(F.lit('{"sub":"'), uuid(key, c), F.lit(f'","iat":{issued_at},"exp":{issued_at + 3600}}}'))
    sign = Stream(key, "jwt", c).chars(43, B62 + "_-")
    return F.concat_ws(".", _base64url(F.lit('{"alg":"HS256","typ":"JWT"}')), _base64url(payload), sign)


def api_key(key: str, c: Column) -> Column:
    """Separators stay; the alphabet follows the letters: hex, lower, upper or mixed."""
    s = Stream(key, "api", c)
    alphabet = (
        F.when(c.rlike("[0-9A-Za-z]") & ~c.rlike("[G-Zg-z]"), HEX)
        .when(c.rlike("[a-z]") & ~c.rlike("[A-Z]"), ALNUM)
        .when(c.rlike("[A-Z]") & ~c.rlike("[a-z]"), ALNUM_UPPER)
        .otherwise(B62)
    )
    return F.when(c == "", s.chars(32, ALNUM)).otherwise(s.mapped(c, "[0-9A-Za-z]", alphabet))


def card(key: str, c: Column) -> Column:
    """13 to 19 digits, the first four kept, a valid check digit; separators go."""
    d = digits(c)
    size = F.least(F.greatest(F.length(d), F.lit(13)), F.lit(19))
    head = F.when(F.length(d) > 0, F.substr(d, F.lit(1), F.lit(4))).otherwise("4")
    body = F.concat(head, Stream(key, "card", c).chars(size - 1 - F.length(head), DIGITS))
    return F.concat(body, luhn_digit(body).cast("string"))


def generic(key: str, c: Column) -> Column:
    """As many bytes; digits, hex, letters or alphanumerics after the original. Separators aren't kept."""
    alphabet = (
        F.when(c.rlike("^[0-9]+$"), DIGITS)
        .when(c.rlike("^[0-9A-Fa-f]+$") & ~c.rlike("^[A-Za-z]+$"), HEX)
        .when(c.rlike("^[A-Za-z]+$"), UPPER + LOWER)
        .otherwise(B62)
    )
    return Stream(key, "generic", c).chars(F.octet_length(c), alphabet)


#: Scheme, user and password up to the last @ of the authority, host and port, path, query, fragment.
_SCHEME, _WHO = r"[A-Za-z][A-Za-z0-9+.-]*://", r"(?:[^/?#]*@)?"
_URL = rf"^({_SCHEME}){_WHO}([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def url_credentials(key: str, c: Column) -> Column:
    """User and password of a URL; what isn't one gets a generic stand-in."""
    s = Stream(key, "url", c)
    who = F.concat(s.chars(8, LOWER, "u"), F.lit(":"), s.chars(20, ALNUM, "p"), F.lit("@"))
    rest = F.regexp_replace(c, f"^{_SCHEME}{_WHO}", "")
    return F.when(c.rlike(f"^{_SCHEME}[^/?#]"), F.concat(F.regexp_extract(c, _URL, 1), who, rest)).otherwise(generic(key, c))


def classify_connection(c: Column) -> Column:
    """jdbc, oracle, url, odbc, ado, libpq or unknown."""
    t, low = F.trim(c), F.lower(F.trim(c))
    pairs = F.size(F.filter(F.split(t, r"\s+"), lambda w: F.contains(w, F.lit("="))))
    both = F.contains(t, F.lit(";")) & F.contains(t, F.lit("="))
    return (
        F.when(t.startswith("jdbc:"), "jdbc")
        .when(t.startswith("(") & F.contains(F.upper(t), F.lit("DESCRIPTION")), "oracle")
        .when(F.contains(t, F.lit("://")), "url")
        .when(both & (F.contains(low, F.lit("driver=")) | F.contains(low, F.lit("driver={"))), "odbc")
        .when(both, "ado")
        .when(pairs >= 2, "libpq")
        .otherwise("unknown")
    )


def _quoted(q: str, closed: str, escape: str = "") -> str:
    """A value between quotes, in which a doubled closing quote, or what follows the escape, counts as text."""
    return rf"{q}(?:[^{closed}{escape}]++|{escape}.)*+{closed}" if escape else rf"{q}(?:[^{closed}]++|{closed}{closed})*+{closed}"


#: name=value parts. Quotes count where a value begins; between them separators are text. What isn't closed ends at the next separator.
_ADO_PART = r"[^=;]*+(?:=\s*+(?:(?:" + "|".join((_quoted('"', '"'), _quoted("'", "'"), _quoted(r"\{", r"\}"))) + r")\s*+(?=;|$)|[^;]*+))?+"
_LIBPQ_PART = r"[^\s='\"]++\s*+=\s*+(?:" + _quoted("'", "'", r"\\") + r"(?=\s|$)|(?:[^\s\\]++|\\.)*+)|\S++"


def _pairs(key: str, c: Column, part: str, joiner: str, roles: dict[str, str]) -> Column:
    """name=value parts with the values of known names replaced, by role: secret, name, host. Quotes around a value stay."""
    role = F.create_map(*[F.lit(x) for k, r in roles.items() for x in (k, r)])
    s = Stream(key, "pairs", c)

    def one(t, i):
        name, value = F.trim(F.substring_index(t, "=", 1)), F.trim(F.regexp_replace(t, "(?s)^[^=]*=", ""))
        own = Stream(key, "pair", F.concat(s.seed, F.lit("|"), i.cast("string")))
        kind = F.try_element_at(role, F.lower(name))
        is_quoted = value.rlike(r"""(?s)^(?:".*"|'.*'|\{.*\})$""") & (F.length(value) > 1)
        size = F.octet_length(value) - F.when(is_quoted, 2).otherwise(0)
        new = (
            F.when(kind == "secret", own.chars(F.greatest(size, F.lit(12)), ALNUM))
            .when(kind == "name", own.chars(F.greatest(size, F.lit(6)), LOWER))
            .when(kind == "host", F.concat(own.chars(10, LOWER), F.lit(".example.com")))
        )
        shown = F.when(is_quoted, F.concat(F.left(value, F.lit(1)), new, F.right(value, F.lit(1)))).otherwise(new)
        return F.when(F.contains(t, F.lit("=")), F.concat(name, F.lit("="), F.coalesce(shown, value))).otherwise(t)

    parts = F.transform(F.regexp_extract_all(c, F.lit(f"(?s){part}"), F.lit(0)), F.trim)
    return F.array_join(F.transform(F.filter(parts, lambda t: t != ""), one), joiner)


_ADO = {"password": "secret", "pwd": "secret", "pass": "secret"} | {k: "name" for k in ("user id", "uid", "user", "username", "userid", "database", "initial catalog")} | {
    k: "host" for k in ("server", "host", "data source", "address", "addr", "network address", "server name")
}
_LIBPQ = {"password": "secret", "passfile": "secret", "host": "host", "hostaddr": "host", "user": "name", "dbname": "name"}


def connection(key: str, c: Column) -> Column:
    """A connection string with user, password, host and database replaced, by its grammar."""
    s = Stream(key, "db", c)

    def parameter(pair):
        """A parameter of a query; its name may be percent-encoded."""
        raw = F.substring_index(pair, "=", 1)
        name = F.lower(F.coalesce(F.try_url_decode(raw), raw))
        new = F.when(name.isin("password", "pwd", "pass"), s.chars(20, ALNUM, "q")).when(name.isin("username", "user", "uid"), s.chars(8, LOWER, "r"))
        return F.when(F.contains(pair, F.lit("=")) & new.isNotNull(), F.concat(raw, F.lit("="), new)).otherwise(pair)

    def url(u: Column) -> Column:
        """What has no numeric port, as when a password holds a bare slash, isn't taken apart but replaced whole."""
        who = F.concat(s.chars(8, LOWER, "u"), F.lit(":"), s.chars(20, ALNUM, "p"), F.lit("@"), s.chars(10, LOWER, "h"), F.lit(".example.com"))
        port = F.regexp_extract(F.regexp_extract(u, _URL, 2), r"(:[0-9]+)$", 1)
        query = F.regexp_extract(u, _URL, 4)
        query = F.when(F.length(query) > 1, F.concat(F.lit("?"), F.array_join(F.transform(F.split(F.substr(query, F.lit(2)), "&"), parameter), "&"))).otherwise(query)
        whole = F.concat(F.regexp_extract(u, _URL, 1), who, port, F.regexp_extract(u, _URL, 3), query, F.regexp_extract(u, _URL, 5))
        readable = u.rlike(rf"^{_SCHEME}{_WHO}(?:\[[^\]/?#]*\]|[^:/?#]*)(?::[0-9]*)?(?:[/?#]|$)") & ~F.contains(F.regexp_extract(u, _URL, 3), F.lit("@"))
        return F.when(readable, whole).otherwise(F.concat(F.lit("postgresql://"), who, F.lit(":5432/"), s.chars(8, LOWER, "d")))

    def ado(x: Column) -> Column:
        out = _pairs(key, x, _ADO_PART, ";", _ADO)
        return F.when(F.rtrim(x).endswith(";"), F.concat(out, F.lit(";"))).otherwise(out)

    rest = F.regexp_replace(c, "^(?:jdbc:)+", "")
    jdbc = F.when(F.contains(rest, F.lit("://")), url(rest)).when(F.contains(rest, F.lit(";")) & F.contains(rest, F.lit("=")), ado(rest)).otherwise(generic(key, rest))
    value = '("[^"]*"|[^)]+)'
    oracle = F.regexp_replace(c, rf"(?i)(HOST\s*=\s*){value}", F.concat(F.lit("$1"), s.chars(10, LOWER, "h"), F.lit(".example.com")))
    oracle = F.regexp_replace(oracle, rf"(?i)(USER(?:_ID|NAME)?\s*=\s*){value}", F.concat(F.lit("$1"), s.chars(8, LOWER, "u")))
    oracle = F.regexp_replace(oracle, rf"(?i)(PASSWORD\s*=\s*){value}", F.concat(F.lit("$1"), s.chars(16, ALNUM, "p")))
    kind = classify_connection(c)
    return (
        F.when(kind == "url", url(c))
        .when(kind == "jdbc", F.concat(F.lit("jdbc:"), jdbc))
        .when(kind.isin("ado", "odbc"), ado(c))
        .when(kind == "libpq", _pairs(key, c, _LIBPQ_PART, " ", _LIBPQ))
        .when(kind == "oracle", oracle)
        .otherwise(generic(key, c))
    )


def _visible(kind: str, key: str, c: Column) -> Column:
    """Stand-ins that a reader recognises at once."""
    s = Stream(key, f"visible-{kind}", c)
    four = F.lpad(s.number(0, 10000).cast("string"), 4, "0")
    digits_ = F.concat(F.lit("400000"), s.chars(9, DIGITS))
    shown = {
        "faker_email": F.concat(s.chars(6, LOWER), F.lit("@example.com")),
        "faker_phone": F.concat(F.lit("+1-555-010-"), four),
        "faker_ssn": F.concat(F.lit("000-00-"), four),
        "faker_ipv4": F.concat(F.lit("203.0.113."), s.number(0, 256).cast("string")),
        "faker_iban": F.lit("GB00MASKED000000000000"),
        "faker_aws_key": F.concat(F.lit("AKIAMASKED"), s.chars(10, ALNUM_UPPER)),
        "faker_github_pat": F.concat(F.lit("ghp_MASKED"), s.chars(30, B62)),
        "faker_api_key": s.chars(32, HEX),
        "faker_cc_luhn": F.concat(digits_, luhn_digit(digits_).cast("string")),
        "faker_db_conn": F.lit("postgresql://masked:masked@masked-db.invalid:5432/dbname"),
        "faker_url_cred": F.concat(F.regexp_extract(c, _URL, 1), F.lit("masked:masked@"), F.regexp_replace(c, f"^{_SCHEME}{_WHO}", "")),
    }
    return shown.get(kind, FAKES[kind](key, c) if kind in FAKES else None)


FAKES = {
    "faker_email": email,
    "faker_phone": phone,
    "faker_ssn": ssn,
    "faker_ipv4": ipv4,
    "faker_uuid": uuid,
    "faker_iban": iban,
    "faker_aws_key": aws_key,
    "faker_github_pat": github_pat,
    "faker_jwt": jwt,
    "faker_api_key": api_key,
    "faker_cc_luhn": card,
    "faker_url_cred": url_credentials,
    "faker_db_conn": connection,
    "generic_random": generic,
}
TYPES = (*FAKES, "fpe_numeric", "passthrough")


def fake(kind: str, key: str, c: Column, literal_prefix: str | None = None, visible: bool = False, rule_id: str | None = None) -> Column:
    """The stand-in of c under a replacement type. passthrough keeps c; fpe_numeric enciphers its digits under the engine's key,
    and with too few of them redacts, as unknown types do, under the rule's name if that is known."""
    hidden = F.lit(f"[REDACTED:{rule_id}]" if rule_id else "[REDACTED]")
    if kind == "passthrough":
        return c
    if kind == "fpe_numeric":
        return F.coalesce(fpe_numeric(c, engine_key(key)), hidden)
    if kind not in FAKES:
        return hidden
    if visible:
        return _visible(kind, key, c)
    made = FAKES[kind](key, c)
    if literal_prefix and kind in ("faker_api_key", "generic_random"):
        rest = F.substr(c, F.lit(len(literal_prefix) + 1))
        kept = F.concat(F.lit(literal_prefix), FAKES[kind](key, rest))
        made = F.when(c.startswith(literal_prefix) & (F.length(c) > len(literal_prefix)), kept).otherwise(made)
    return made


def engine_key(key: str) -> bytes:
    """32 bytes for ciphers, from the engine's key."""
    return hashlib.sha256(f"{key}|fpe".encode()).digest()


def _after_prefix(make, key: str, c: Column, prefix: Column) -> Column:
    return bound(prefix, lambda head: F.concat(head, bound(F.substr(c, F.length(head) + 1), lambda rest: make(key, rest))))


def fake_of_rule(kinds, kind: Column, key: str, c: Column, prefix: Column, rule_id: Column, enciphered: Column, visible: bool = False) -> Column:
    """fake() where type, literal prefix and rule are columns. kinds: the types that occur, so that the expression has no others; its size doesn't
    depend on the number of rules. enciphered: what fpe_numeric gives, as that runs in Python."""
    hidden = F.concat(F.lit("[REDACTED:"), rule_id, F.lit("]"))
    kept = F.when(c.startswith(prefix) & (F.length(c) > F.length(prefix)), prefix).otherwise("")
    out = F.when(kind == "passthrough", c).when(kind == "fpe_numeric", F.coalesce(enciphered, hidden))
    for name in FAKES:
        if name not in kinds:
            continue
        if visible:
            made = _visible(name, key, c)
        elif name in ("faker_api_key", "generic_random"):
            made = _after_prefix(FAKES[name], key, c, kept)
        else:
            made = FAKES[name](key, c)
        out = out.when(kind == name, made)
    return out.otherwise(hidden)


def fake_by_type(kind: Column, key: str, c: Column, visible: bool = False, rule_id: Column | None = None) -> Column:
    """Dispatch on a column of replacement types."""
    hidden = F.lit("[REDACTED]") if rule_id is None else F.concat(F.lit("[REDACTED:"), rule_id, F.lit("]"))
    out = F.when(kind == "passthrough", c)
    for name in FAKES:
        out = out.when(kind == name, fake(name, key, c, visible=visible))
    return out.when(kind == "fpe_numeric", F.coalesce(fpe_numeric(F.when(kind == "fpe_numeric", c), engine_key(key)), hidden)).otherwise(hidden)
