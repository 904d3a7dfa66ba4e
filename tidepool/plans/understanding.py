"""Query understanding: a query's intent, time, file hints and terms; a time phrase's range. Pure, on the driver."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from tidepool.functions.text import STOPWORDS

#: Known file extensions, and the words that tell a kind of file.
EXTENSIONS = ["pdf", "docx", "doc", "txt", "md", "markdown", "png", "jpg", "jpeg", "py", "js", "ts", "go", "rs", "java", "cpp", "c", "h", "html", "css"]
DOCUMENT_WORDS = ["pdf", "docx", "doc", "txt", "md", "markdown"]
IMAGE_WORDS = ["screenshot", "image", "photo", "picture", "png", "jpg", "jpeg"]
CODE_WORDS = ["py", "js", "ts", "go", "rs", "java", "cpp", "c"]
DROPPED_NOUNS = ["screenshot", "image", "photo", "picture", "file", "files", "document", "documents"]
#: MIME types of the hints that restrict the full-text path.
HINT_MIME = {"image": "image/", "pdf": "pdf", "docx": "wordprocessingml", "txt": "text/plain", "md": "text/markdown"}
MONTHS = [m.lower() for m in calendar.month_name[1:]]
DAYS = [d.lower() for d in calendar.day_name]
_MONTH, _DAY = "|".join(MONTHS), "|".join(DAYS)
#: The phrases of time a query may hold, in the order in which they are looked for.
TIME_PHRASES = [
    rf"around\s+(?:{_MONTH})",
    rf"in\s+(?:{_MONTH})(?:\s+\d{{4}})?",
    r"between\s+\d{1,2}(?:am|pm)?\s+and\s+\d{1,2}(?:am|pm)?(?:\s+on\s+\d{4}-\d{2}-\d{2})?",
    rf"last\s+(?:{_DAY})",
    r"last\s+(?:week|month|year)",
    r"this\s+(?:week|month|year)",
    r"today|yesterday|tomorrow",
    r"\d{4}-\d{2}-\d{2}",
    r"two\s+days\s+ago",
]
#: What tells a question for activity, and one for pictures.
ACTIVITY = r"\bwhat\s+(?:did\s+i|was\s+i)\s+(?:work|do|working|doing)\b|\bwhat\s+files\s+did\s+i\b"
PICTURE = r"\bscreenshot\b|\bimage\s+of\b|\bphoto\b|\bpicture\b"
_TOKEN = r"\b[a-zA-Z0-9._-]+\b"


@dataclass(frozen=True)
class Understood:
    original: str
    terms: list[str] = field(default_factory=list)
    filename_hint: str = ""
    file_type: str = ""
    intent: str = "search"
    time_expression: str = ""

    @property
    def topic_hints(self) -> list[str]:
        return self.terms

    @property
    def has_temporal(self) -> bool:
        return bool(self.time_expression)


@dataclass(frozen=True)
class TimeRange:
    start: datetime | None = None
    end: datetime | None = None
    precision: str = "unresolved"
    original_expression: str = ""

    @property
    def resolved(self) -> bool:
        return self.start is not None

    def micros(self) -> tuple[int, int] | tuple[None, None]:
        if not self.resolved:
            return None, None
        us = lambda t: round((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
        return us(self.start), us(self.end)


def _find(pattern: str, text: str) -> str:
    found = re.search(pattern, text, re.IGNORECASE)
    return found[0] if found else ""


#: Rules of the parts of a query, the first that holds counts: what it tells, and what has to be found in the text.
INTENT_RULES = [("activity", ACTIVITY), ("screenshot", PICTURE)]
_FILE_NAME = rf"\b[a-zA-Z0-9_-]+\.(?:{'|'.join(EXTENSIONS)})\b"


def _first_rule(rules: list[tuple[str, str]], text: str, otherwise: str) -> str:
    return next((told for told, pattern in rules if _find(pattern, text)), otherwise)


def _kind_of(hint: str, words: list[str]) -> str:
    """The kind of file: by the hint's extension, else by the words, document words telling themselves."""
    if hint:
        return hint.lower().rsplit(".", 1)[1]
    groups = [(DOCUMENT_WORDS, None), (IMAGE_WORDS, "image"), (CODE_WORDS, "code")]
    return next((told or w for group, told in groups for w in words if w in group), "")


def understand(query: str) -> Understood:
    """A query's parts. Blank queries have none."""
    text = (query or "").strip()
    if not text:
        return Understood(query or "")
    phrase = next(filter(None, (_find(rf"\b(?:{p})\b", text) for p in TIME_PHRASES)), "")
    hint = _find(_FILE_NAME, text)
    tokens = lambda t: [w.lower() for w in re.findall(_TOKEN, t)]
    unwanted = {*STOPWORDS, *DROPPED_NOUNS, *(() if hint else (e for e in EXTENSIONS if len(e) <= 4))}
    rest = re.sub(re.escape(phrase), "", text, flags=re.IGNORECASE) if phrase else text
    terms = [w for w in dict.fromkeys(tokens(rest)) if w not in unwanted]
    return Understood(text, terms, hint, _kind_of(hint, tokens(text)), _first_rule(INTENT_RULES, text, "search"), phrase)


def _day(at: datetime) -> datetime:
    return at.replace(hour=0, minute=0, second=0, microsecond=0)


def _through(first: datetime, last: datetime) -> tuple[datetime, datetime]:
    return _day(first), _day(last) + timedelta(days=1, microseconds=-1)


def _hour(number: str, half: str) -> int:
    return int(number) % 12 + 12 * (half == "pm") if int(number) <= 12 else int(number)


def _month_year(name: str, year: str | None, now: datetime) -> tuple[int, int]:
    month = MONTHS.index(name) + 1
    return month, int(year) if year else now.year - (month > now.month)


def _weekday(now: datetime, m: re.Match):
    back = (now.weekday() - DAYS.index(m[1])) % 7 or 7
    return *_through(now - timedelta(days=back), now - timedelta(days=back)), "exact_day"


def _around(now: datetime, m: re.Match):
    month, year = _month_year(m[1], None, now)
    middle = datetime(year, month, 15, 12, tzinfo=UTC)
    return middle - timedelta(weeks=6), middle + timedelta(weeks=6), "approximate"


def _in_month(now: datetime, m: re.Match):
    month, year = _month_year(m[1], m[2], now)
    first = datetime(year, month, 1, tzinfo=UTC)
    return *_through(first, first.replace(day=calendar.monthrange(year, month)[1])), "month"


def _last_month(now: datetime, m: re.Match):
    last = _day(now).replace(day=1) - timedelta(days=1)
    return *_through(last.replace(day=1), last), "month"


def _date(now: datetime, m: re.Match):
    day = datetime(int(m[1]), int(m[2]), int(m[3]), tzinfo=UTC)
    return *_through(day, day), "exact_day"


def _between(now: datetime, m: re.Match):
    day = datetime.fromisoformat(m[5]).replace(tzinfo=UTC) if m[5] else _day(now)
    return day.replace(hour=_hour(m[1], m[2])), day.replace(hour=_hour(m[3], m[4])), "exact_day"


def _days_ago(n: int):
    return lambda now, m: (*_through(now - timedelta(days=n), now - timedelta(days=n)), "exact_day")


def _week(n: int):
    def run(now: datetime, m: re.Match):
        monday = now - timedelta(days=now.weekday() + 7 * n)
        return *_through(monday, now if n == 0 else monday + timedelta(days=6)), "week"

    return run


#: What a whole phrase means. Phrases that are found but not listed here stay unresolved.
MEANINGS: list[tuple[str, Callable]] = [
    ("today", _days_ago(0)),
    ("yesterday", _days_ago(1)),
    (r"two\s+days\s+ago", _days_ago(2)),
    (rf"last\s+({_DAY})", _weekday),
    (r"last\s+week", _week(1)),
    (r"this\s+week", _week(0)),
    (r"last\s+month", _last_month),
    (rf"around\s+({_MONTH})", _around),
    (rf"in\s+({_MONTH})(?:\s+(\d{{4}}))?", _in_month),
    (r"(\d{4})-(\d{2})-(\d{2})", _date),
    (r"between\s+(\d{1,2})(am|pm)\s+and\s+(\d{1,2})(am|pm)(?:\s+on\s+(\d{4}-\d{2}-\d{2}))?", _between),
]


def resolve_time(phrase: str, now: datetime) -> TimeRange:
    """The range a phrase means, seen from now (without zone: UTC). Impossible dates and hours stay unresolved."""
    said = (phrase or "").strip()
    now = now.replace(tzinfo=UTC) if now.tzinfo is None else now.astimezone(UTC)
    for pattern, meaning in MEANINGS:
        if m := re.fullmatch(pattern, said.lower()):
            try:
                start, end, precision = meaning(now, m)
            except ValueError:
                break
            return TimeRange(start, end, precision, said)
    return TimeRange(original_expression=said)
