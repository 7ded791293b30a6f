"""Column builders over block and line text. Patterns are kept to what Java and RE2 read alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECISION = "DECISION:"
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
ALARM = r"(?i)exception|error|fatal|fail|panic|traceback|warn"
VERDICT = (
    r"(?i)(?:\b[0-9]+ +(?:todo|pending|skipped|fail(?:ing|ed)|pass(?:ing|ed)|error(?:ed|s)?)\b|\btest result:"
    r"|^\s*(?:pass|fail|ok)\b|^\s*--- +(?:skip|pass|fail):|\bbuild (?:fail(?:ure|ed)|success(?:ful)?)\b"
    r"|\bexit (?:status|code) +[0-9]+|=+.*\b(?:error|passed|failed)\b.*=+)"
)
RED = (
    r"(?i)(?:\b[1-9][0-9]* +(?:errors?|fail(?:ing|ed))\b|^\s*fail\b|^\s*--- +fail:"
    r"|\bbuild fail(?:ure|ed)\b|\bexit (?:status|code) +[1-9])"
)
FRAME = r'^\s*File ".*", line [0-9]+|Traceback \(most recent call last\)'
DIFF_HEAD = r"^\+\+\+|^---|^@@|^diff --git"
SURPRISE = (
    r"(?i)\b(?:abort(?:ed)?|assert(?:ion)?(?:\s*(?:failed|error))?|cannot|core\s+dumped|denied|error|exception"
    r"|fail(?:ing|ure|ed)?|fatal|mismatch|no\s+such|not\s+found|panic|permission\s+denied|refused|rejected|segfault"
    r"|timed\s+out|timeout|traceback|unable\s+to|unexpected)\b|\bexit(?:ed|\s+code)?\s+[1-9][0-9]*\b|\b[EW][0-9]{3,}\b"
)
#: Identifier shapes that RE2 reads too; mixed hexadecimal is judged by a second test.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
TICKET = r"\b[A-Z][A-Z0-9]+-[A-Za-z0-9]+\b"
HEX = r"\b[0-9a-f]{7,40}\b"
ANCHOR = r"[A-Za-z0-9][A-Za-z0-9_./-]{3,}"
TERM = r"[A-Za-z_][\p{L}\p{N}_./-]{2,}"
VARIABLE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[TZ0-9:.-]*|\b[0-9A-Fa-f]{8,}\b|\b[0-9]+(?:\.[0-9]+)?"
SLOT = "§"
STOP_TERMS = tuple(
    "all and any are class com const def export for from get have http https import into let name none not null org out result return run set that the then this true type use using value var was when with www you your false".split()
)
ALARM_WORDS = ("breach", "crashloop", "denied", "error", "exception", "fail", "traceback")
DEBUG_WORDS = "debug|fixme|noqa|todo|trace|verbose"
STRUCTURED = r"^\s*[{\[]|^\s*[\p{L}\p{N}_.-]+\s*:\s*[^\s]|\|"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(text) -> Column:
    """1.33 tokens for each word or symbol, half-even rounding, at least 1; 0 for an empty text."""
    t = _c(text)
    n = F.bround(F.regexp_count(t, F.lit(PIECE)) * F.lit(1.33)).cast("long")
    return F.when(F.length(t) == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), n))


def handle(text) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 8)


def lines(text) -> Column:
    """The lines of a text; a final line feed opens no further line."""
    parts = F.split(_c(text), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def shape(line) -> Column:
    flat = F.regexp_replace(F.trim(F.regexp_replace(_c(line), r"\s+", " ")), r"0x[0-9a-fA-F]+|[0-9]+", "#")
    return F.lower(flat)


def content_kind(text) -> Column:
    t = _c(text)
    return (
        F.when(t.rlike(r"(?m)^@@|^diff --git"), "diff").when(t.rlike("(?m)" + VERDICT), "log").when(t.rlike("(?m)" + FRAME), "traceback").otherwise("generic")
    )


def must_keep(line, kind) -> Column:
    x, k = _c(line), _c(kind)
    return (
        x.contains(DECISION) | x.rlike(ALARM) | ((k == "log") & x.rlike(VERDICT)) | ((k == "traceback") & x.rlike(FRAME)) | ((k == "diff") & x.rlike(DIFF_HEAD))
    )


def keep_score(line) -> Column:
    """How much a line deserves to stay: blank 0, answers 1, alarms .95, debug .1, structured .7, numbers .6, else .3."""
    x = _c(line)
    s = F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))
    low = F.lower(s)
    return (
        F.when(s == "", 0.0)
        .when(x.contains(DECISION) | x.rlike(VERDICT), 1.0)
        .when(low.rlike("|".join(ALARM_WORDS)), 0.95)
        .when(low.rlike(DEBUG_WORDS), 0.1)
        .when(s.rlike(STRUCTURED), 0.7)
        .when(F.regexp_count(s, F.lit(NUMBER)) >= 2, 0.6)
        .otherwise(0.3)
    )


def signature(text) -> Column:
    """Content class and size, without content: json, error, code, log or prose; s, m, l or xl."""
    t = _c(text)
    head = F.substring(t, 1, 400)
    n = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    kind = (
        F.when(t.rlike(r"^\s*[{\[]"), "json")
        .when(head.rlike(r'(?m)^\s*File ".*", line |Error:|Exception|Traceback'), "error")
        .when(head.rlike(r"(?m)^\s*(?:private |public |let |const |function |import |class |def )"), "code")
        .when(head.rlike(r"\b(?:TRACE|ERROR|WARN|DEBUG|INFO)\b|[0-9]{4}-[0-9]{2}-[0-9]{2}"), "log")
        .otherwise("prose")
    )
    size = F.when(n < 10, "s").when(n < 40, "m").when(n < 150, "l").otherwise("xl")
    return F.concat(kind, F.lit(":"), size)


def entropy(token) -> Column:
    """Shannon entropy of a token's characters, in bits."""
    chars = F.split(_c(token), "")
    n = F.size(chars)
    total = F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda d: d == c)) / n) * F.log2(F.size(F.filter(chars, lambda d: d == c)) / n)
    )
    return F.when(F.length(_c(token)) == 0, 0.0).otherwise(total)


def terms(text) -> Column:
    """Distinct lower-case identifier-like terms, without stop words."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(_c(text), F.lit(TERM), F.lit(0)), F.lower))
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_TERMS]))


def informativeness(line) -> Column:
    """Distinct alphanumeric words of more than two characters."""
    words = F.split(F.regexp_replace(F.lower(_c(line)), r"[^\p{L}\p{N}]+", " "), " ")
    return F.size(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)))


FEATURES = ("bias", "decision", "alarm", "structured", "digits", "length", "debug", "capitals", "blank")


def features(line) -> list[Column]:
    """The nine features of a line, named as in FEATURES; all but bias and blank are 0 on a blank line."""
    x = _c(line)
    s = F.regexp_replace(x, r"^\s+|\s+$", "")
    n, blank = F.length(s), s == ""
    flag = lambda c: F.when(blank, 0.0).otherwise(c.cast("double"))
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    cols = [
        F.lit(1.0), flag(x.contains(DECISION)), flag(F.lower(s).rlike("|".join(ALARM_WORDS))), flag(s.rlike(STRUCTURED)),
        flag(F.least(F.regexp_count(s, F.lit(r"[0-9]")) / F.greatest(n, F.lit(1)), F.lit(1.0))), flag(F.least(n / 120.0, F.lit(1.0))),
        flag(F.lower(s).rlike(DEBUG_WORDS)), flag(F.regexp_count(s, F.lit(r"\p{Lu}")) / F.greatest(letters, F.lit(1))), blank.cast("double"),
    ]
    return [c.alias(n) for c, n in zip(cols, FEATURES, strict=True)]
