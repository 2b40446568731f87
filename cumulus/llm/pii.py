"""Operator 10: format-preserving Feistel pseudonyms of personal data, in DataFrame functions only.

Candidates are found by their format and validated: card numbers by the Luhn sum,
account numbers (IBAN) by their remainder of 97, social security numbers by their
ranges, addresses (IPv4) by their octets, dates by the calendar.  Then a keyed
Feistel network permutes the value within its format: digits to digits, letters to
letters, dates to dates; check digits are computed anew.  The permutation hangs on
the value and the key alone, so equal values get equal pseudonyms in all documents,
and different values of a kind different ones.  Dates stay in their span of years
(0 to 1899, 1900 to 2099, 2100 to 9999); a letter outside A-Z stays within the 64
code points around it.  What fails validation stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8             # an even number
WALK = 16              # steps of a cycle walk that looks for a valid value
#: Spans of years that a date stays in: first day, days, and two sides whose product is as large or a little larger.
SPANS = (("0000-01-01", 693961, (833, 834)), ("1900-01-01", 73049, (270, 271)), ("2100-01-01", 2885415, (1699, 1699)))

# ---- fixed values: formats, in the order in which they are tried --------------------------
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+\.)+[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = (r"(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}"
        r"|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z/\-]|\.[0-9])")
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = (r"(?<![0-9A-Za-z+(\-])(?:\+?[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[.\- ])[0-9]{3,4}[ .\-][0-9]{3,4}(?![0-9A-Za-z]|-[0-9])"
         r"|(?<![0-9A-Za-z+(])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z]|-[0-9])"
         r"|(?<![0-9A-Za-z+(\-])[0-9]{3}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])")
CARD = r"(?<![0-9A-Za-z\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "date": DATE, "ipv4": IPV4, "ssn": SSN, "card": CARD, "phone": PHONE}


def _quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Feistel:
    """SQL expressions of the keyed permutations."""

    def __init__(self, key: str):
        self.key = key

    def number(self, kind: str, turn: str, place: str, other: str) -> str:
        """The round function: a 48-bit number from the key, the kind, the round, the place and the other half."""
        return (f"cast(conv(substr(sha2(concat_ws('|', {_quoted(self.key)}, '{kind}', {turn}, {place}, {other}), 256), "
                "1, 12), 16, 10) AS bigint)")

    def text(self, value: str, kind: str, letters: int = 26) -> str:
        """Permute a string within its format: every digit stays a digit, every letter a letter of its case
        (of the first ``letters`` of the alphabet), a letter outside A-Z one of its block of 64 code points; other
        characters stay.  The case of A-Z does not change the pseudonym."""
        number = self.number(kind, "turn", "i", "lower(s.r)")

        def moved(first: int, size: int) -> str:
            return f"chr({first} + cast((ascii(c) - {first} + {number}) % {size} AS int))"

        # Of the 64 code points around a letter outside A-Z, the next by steps of this number that is a letter: the
        # first return of a rotation, which is one-to-one and comes back to the letter itself after 64 steps at most.
        around = f"(ascii(w) div 64 * 64 + (ascii(w) + {number}) % 64)"
        returned = (f"aggregate(sequence(1, 64), named_struct('w', c, 'end', false), (g, step) -> CASE WHEN g.end THEN g ELSE "
                    + _let("w", "g.w", _let("v", _character(around), "named_struct('w', v, 'end', v RLIKE '\\\\p{L}')"))
                    + " END, g -> g.w)")
        character = (f"CASE WHEN c BETWEEN '0' AND '9' THEN {moved(48, 10)} WHEN c BETWEEN 'a' AND 'z' THEN {moved(97, letters)} "
                     f"WHEN c BETWEEN 'A' AND 'Z' THEN {moved(65, letters)} WHEN c RLIKE '\\\\p{{L}}' THEN {returned} ELSE c END")
        half = (f"CASE WHEN length(s.l) = 0 THEN '' ELSE array_join(transform(sequence(1, length(s.l)), i -> "
                f"element_at(transform(array(substr(s.l, i, 1)), c -> {character}), 1)), '') END")
        start = f"named_struct('l', substr({value}, 1, cast(length({value}) / 2 AS int)), 'r', substr({value}, cast(length({value}) / 2 AS int) + 1))"
        return (f"aggregate(sequence(1, {ROUNDS}), {start}, (s, turn) -> named_struct('l', s.r, 'r', {half}), "
                "s -> concat(s.l, s.r))")

    def numbers(self, left: str, right: str, sides: tuple[int | str, int | str], kind: str) -> str:
        """Permute a pair of numbers below the two sides (numbers or SQL); the result is a struct (l, r)."""
        a, b = sides
        turn_l = f"cast((s.l + {self.number(kind, 'turn', '0', 's.r')}) % {a} AS bigint)"
        turn_r = f"cast((s.r + {self.number(kind, 'turn', '1', 's.l')}) % {b} AS bigint)"
        start = f"named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint))"
        return (f"aggregate(sequence(1, {ROUNDS}), {start}, (s, turn) -> CASE WHEN turn % 2 = 1 THEN "
                f"named_struct('l', {turn_l}, 'r', s.r) ELSE named_struct('l', s.l, 'r', {turn_r}) END)")


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _character(code: str) -> str:
    """SQL: the character of a code point."""
    return f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"


def _refilled(form: str, symbols: str, allowed: str) -> str:
    """SQL: the characters of ``form`` that match ``allowed``, replaced in turn by those of ``symbols``."""
    return (f"aggregate(sequence(1, length({form})), named_struct('o', '', 'k', 1), (a, i) -> CASE WHEN "
            f"substr({form}, i, 1) RLIKE '{allowed}' THEN named_struct('o', concat(a.o, substr({symbols}, a.k, 1)), "
            f"'k', a.k + 1) ELSE named_struct('o', concat(a.o, substr({form}, i, 1)), 'k', a.k) END, a -> a.o)")


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum's remainder of 10."""
    digit = f"cast(substr({digits}, i, 1) AS int)"
    return (f"(aggregate(sequence(1, length({digits})), 0, (a, i) -> a + CASE WHEN (length({digits}) - i) % 2 = 1 THEN "
            f"{digit} * 2 - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END) % 10)")


def _mod97(symbols: str) -> str:
    """SQL: an account number's remainder of 97, letters counting from 10."""
    c = f"substr({symbols}, i, 1)"
    return (f"aggregate(sequence(1, length({symbols})), 0, (a, i) -> CASE WHEN {c} BETWEEN '0' AND '9' THEN "
            f"(a * 10 + cast({c} AS int)) % 97 ELSE (a * 100 + ascii({c}) - 55) % 97 END)")


def _pseudonym(net: Feistel) -> str:
    """SQL: the pseudonym of a match ``m``, or ``m`` itself where validation fails."""
    email = f"concat({net.text('substring_index(m, ' + _quoted('@') + ', 1)', 'email')}, '@', substring_index(m, '@', -1))"
    secret = net.text("m", "secret", 6)
    digits = "regexp_replace(m, '[^0-9]', '')"
    symbols = "regexp_replace(m, ' ', '')"
    bban = net.text("substr(v, 5)", "iban")
    new_bban = _let("b", bban, f"concat(substr(v, 1, 2), lpad(cast(98 - {_mod97('concat(b, substr(v, 1, 2), ' + _quoted('00') + ')')} AS string), 2, '0'), b)")
    iban = _let("v", symbols, f"CASE WHEN {_mod97('concat(substr(v, 5), substr(v, 1, 4))')} = 1 THEN "
                + _let("w", new_bban, _refilled("m", "w", "[A-Z0-9]")) + " ELSE m END")
    card = _let("d", digits, f"CASE WHEN {_luhn('d')} = 0 THEN " + _let(
        "p", net.text("substr(d, 1, length(d) - 1)", "card"), _let(
            "w", f"concat(p, cast((10 - {_luhn('concat(p, ' + _quoted('0') + ')')}) % 10 AS string))",
            _refilled("m", "w", "[0-9]"))) + " ELSE m END")
    valid = "(substr({v}, 1, 3) NOT IN ('000', '666') AND substr({v}, 1, 1) != '9' AND substr({v}, 4, 2) != '00' AND substr({v}, 6) != '0000')"
    ssn = _let("d", digits, f"CASE WHEN {valid.format(v='d')} THEN " + _let(
        "w", f"aggregate(sequence(1, {WALK}), {net.text('d', 'ssn')}, (t, step) -> CASE WHEN {valid.format(v='t')} THEN t ELSE "
             f"{net.text('t', 'ssn')} END)", _refilled("m", "w", "[0-9]")) + " ELSE m END")
    kept = "greatest(length(d) - 10, 0)"
    phone = _let("d", digits, _let("w", f"concat(substr(d, 1, {kept}), {net.text(f'substr(d, {kept} + 1)', 'phone')})",
                                   _refilled("m", "w", "[0-9]")))
    octets = "transform(split(m, '[.]'), x -> cast(x AS int))"
    ipv4 = _let("o", octets, "CASE WHEN forall(o, x -> x <= 255) THEN " + _let(
        "h", net.numbers("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", (65536, 65536), "ipv4"),
        "concat_ws('.', cast(h.l div 256 AS string), cast(h.l % 256 AS string), cast(h.r div 256 AS string), "
        "cast(h.r % 256 AS string))") + " ELSE m END")
    parts = "split(m, '[./-]')"
    separator = "regexp_extract(m, '[./-]', 0)"
    read = ("CASE WHEN length(q[0]) = 4 THEN try_to_date(concat_ws('-', q[0], lpad(q[1], 2, '0'), lpad(q[2], 2, '0')), 'yyyy-MM-dd') "
            "ELSE coalesce({dm}, {md}) END").format(
        dm="try_to_date(concat_ws('-', q[2], lpad(q[1], 2, '0'), lpad(q[0], 2, '0')), 'yyyy-MM-dd')",
        md="try_to_date(concat_ws('-', q[2], lpad(q[0], 2, '0'), lpad(q[1], 2, '0')), 'yyyy-MM-dd')")
    step = _let("h", net.numbers("n div z.b", "n % z.b", ("z.a", "z.b"), "date"), "h.l * z.b + h.r")
    walked = (f"aggregate(sequence(1, {WALK}), cast(-1 AS bigint), (n0, step) -> CASE WHEN n0 BETWEEN 0 AND z.days - 1 THEN n0 ELSE "
              + _let("n", "CASE WHEN n0 < 0 THEN cast(datediff(day, z.first) AS bigint) ELSE n0 END", step) + " END)")
    span = " ".join(f"WHEN day >= DATE'{first}' THEN named_struct('first', DATE'{first}', 'days', {days}, 'a', {a}, 'b', {b})"
                    for first, days, (a, b) in reversed(SPANS))
    month_first = "(length(q[0]) < 4 AND cast(q[1] AS int) > 12)"

    def shown(pattern: str, part: str) -> str:
        return f"CASE WHEN length({part}) = 2 THEN date_format(t, '{pattern * 2}') ELSE date_format(t, '{pattern}') END"

    written = (f"CASE WHEN length(q[0]) = 4 THEN concat_ws({separator}, date_format(t, 'yyyy'), {shown('M', 'q[1]')}, {shown('d', 'q[2]')}) "
               f"WHEN {month_first} THEN concat_ws({separator}, {shown('M', 'q[0]')}, {shown('d', 'q[1]')}, date_format(t, 'yyyy')) "
               f"ELSE concat_ws({separator}, {shown('d', 'q[0]')}, {shown('M', 'q[1]')}, date_format(t, 'yyyy')) END")
    moved = _let("z", f"CASE {span} END", _let("t", f"date_add(z.first, cast({walked} AS int))", written))
    date = _let("q", parts, _let("day", read, f"CASE WHEN day IS NOT NULL THEN {moved} ELSE m END"))
    ways = {"email": email, "secret": secret, "iban": iban, "date": date, "ipv4": ipv4, "ssn": ssn, "card": card, "phone": phone}
    cases = " ".join(f"WHEN m RLIKE {_quoted('^(?:' + KINDS[k] + ')$')} THEN {ways[k]}" for k in KINDS)
    return f"CASE {cases} ELSE m END"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_pseudonyms") -> DataFrame:
    """Replace personal data in a text column by pseudonyms; all other columns stay.

    ``count`` names a column (long) for the number of values replaced.  A null text
    stays null with a count of 0; an empty text stays empty.  Rows are independent,
    so repeated rows and ties get equal results; an empty table gives an empty table.
    A column that already has the name of ``count`` is replaced; all others may have any name.
    """
    pattern = "|".join(f"(?:{p})" for p in KINDS.values())
    names = {f"other_{i}": c for i, c in enumerate(docs.columns) if c != count or c == text}
    docs = docs.toDF(*[f"other_{i}" for i in range(len(docs.columns))])
    body = next(F.col(new) for new, old in names.items() if old == text)
    # Texts without a digit or an at sign hold none of the formats (a secret has 32 hex digits).
    some = body.rlike(r"[0-9@]|[A-Fa-f]{32}") & body.rlike(pattern)
    cut = docs.select(*names, F.when(some, F.split(body, pattern, -1)).alias("between"),
                      F.when(some, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).alias("found"))
    changed = cut.select("*", F.expr(f"transform(found, m -> {_pseudonym(Feistel(key))})").alias("new"))
    whole = F.expr("concat(element_at(between, 1), array_join(transform(new, (x, i) -> "
                   "concat(x, element_at(between, i + 2))), ''))")
    replaced = F.expr("cast(coalesce(size(filter(zip_with(found, new, (x, y) -> x != y), z -> z)), 0) AS bigint)")
    out = [F.when(F.col("new").isNotNull(), whole).otherwise(F.col(new)).alias(old) if old == text else F.col(new).alias(old)
           for new, old in names.items()]
    if count:
        out.append(F.greatest(replaced, F.lit(0).cast("long")).alias(count))
    return changed.select(*out)
