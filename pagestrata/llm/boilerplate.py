"""Site boilerplate around the main content of Markdown pages.

A page is read as a tree of blocks (runs of lines without a blank line) and lines, and its subtrees are hashed
in three ways: a block with labels, headings or rows of a table by all its words; a line by its words; and an
element whose words differ from page to page (a breadcrumb, a table of contents with its entries, an edit link,
a previous/next pair, a column of labels before the title) by its kind alone, with slots for what changes. The
fixed phrases below only say what kind of element a line may be. Spark counts on how many pages of its host each
hash occurs, and subtrees that recur on a large share of the host's pages are deleted; nothing is deleted that
doesn't recur. A heading that recurs goes with its section.

Texts are read once: the first pass leaves a role and a hash for each line, the second one decides from
these and from the host's recurring hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.functions.text import SPACES
from pagestrata.session import broadcast_if_small, cut

#: A sentence is the site's own if it is on this share of the host's pages, a label if its menu's labels are.
SENTENCE_SHARE = 0.15
LABEL_SHARE = 0.2
#: An element with slots is the site's own if elements of its kind are on this share of the host's pages.
ELEMENT_SHARE = 0.01
LEAST_PAGES = 4

BLANK, TEXT, ITEM, LINK, HEADING, TITLE, CODE, TABLE, QUOTE, BULLET = range(10)
ENTRIES = (ITEM, LINK, BULLET)
#: Elements with slots. Their roles are above those of other lines, and are the hashes that are counted.
FIRST_ELEMENT = 16
ELEMENTS = ["skip", "search", "menu", "consent", "feedback", "edit", "follow", "version", "legal", "pair", "path", "advert", "list", "one", "cookies", "index", "column"]
ELEMENT = {name: FIRST_ELEMENT + k for k, name in enumerate(ELEMENTS)}
MENU_LINE, CONSENT_LINE, PATH, ADVERT, OPENS_LIST, OPENS_ONE, COOKIES, INDEX, COLUMN = (ELEMENT[n] for n in ("menu", "consent", "path", "advert", "list", "one", "cookies", "index", "column"))
#: What the lines behind an element are taken for, as they are in its subtree.
OPENS = {OPENS_LIST: "list", OPENS_ONE: "one", COOKIES: "cookies", INDEX: "index"}

# The phrases of chrome in six languages, in lower case.
SKIP = [
    "skip navigation", "skip to content", "skip to main content", "jump to content", "open sidebar", "close sidebar", "toggle menu", "toggle navigation", "open menu", "close menu",
    "zum inhalt", "zum inhalt springen", "menü öffnen", "menü schließen", "saltar al contenido", "ir al contenido", "abrir menú", "cerrar menú",
    "к содержанию", "перейти к содержанию", "открыть меню", "закрыть меню", "mở menu", "đóng menu", "đến nội dung", "tới nội dung", "本文へ", "メニュー", "メニューを開く",
]
SEARCH = ["search", "search docs", "search the docs", "search…", "search...", "find anything", "ask a question", "type to search", "suchen", "suche", "doku durchsuchen", "buscar", "поиск", "tìm kiếm", "検索"]
MENU = [
    "home", "docs", "guides", "tutorials", "blog", "pricing", "status", "support", "community", "changelog", "release notes", "api reference", "sign in", "sign up", "log in", "contact sales",
    "contact", "terms", "privacy", "cookies", "legal", "imprint", "press", "careers", "partners", "security", "about", "about us",
    "agb", "datenschutz", "impressum", "karriere", "kontakt", "presse", "rechtliches", "aviso legal", "contacto", "empleo", "prensa", "privacidad", "condiciones", "términos",
    "вакансии", "конфиденциальность", "контакты", "пресса", "условия", "bảo mật", "liên hệ", "tuyển dụng", "điều khoản", "báo chí", "規約", "個人情報", "採用", "問い合わせ", "報道",
]
CONSENT = [
    "accept", "accept all", "got it", "manage", "only necessary", "preferences", "reject", "reject all", "settings", "ablehnen", "alle ablehnen", "einstellungen", "verstanden", "akzeptieren", "alle akzeptieren", "annehmen", "alle annehmen",
    "aceptar", "aceptar todo", "ajustes", "rechazar", "настройки", "отклонить", "принять", "từ chối", "tùy chọn", "đồng ý", "同意する", "拒否", "設定",
]
FEEDBACK = [
    "was this helpful", "was this page helpful", "did this page help", "feedback", "how did we do", "rate this page", "war das hilfreich", "seite bewerten", "¿le sirvió", "valore la página",
    "было полезно", "оцените страницу", "có hữu ích", "đánh giá", "役に立ちましたか", "評価する", "このページを評価",
]
EDIT = [
    "edit this page", "suggest an edit", "view source", "improve this doc", "report an issue", "seite bearbeiten", "fehler melden", "editar página", "avisar de un error",
    "править страницу", "сообщить об ошибке", "sửa trang", "báo lỗi", "編集する", "誤りを報告", "問題を報告",
]
FOLLOW = [
    "subscribe for updates", "follow us", "stay in the loop", "get product news by mail", "newsletter abonnieren", "folgen sie uns", "suscríbase", "síganos", "подписаться", "đăng ký", "購読する",
]
CONTENTS = [
    "contents", "table of contents", "on this page", "in this article", "jump to", "inhalt", "auf dieser seite", "contenido", "en esta página", "содержание", "на этой странице",
    "mục lục", "trong trang", "目次", "このページの内容",
]
RELATED = [
    "keep reading", "see what others read", "you may also like", "more in this section", "related articles", "related pages", "ähnliche artikel", "mehr dazu", "artículos relacionados",
    "похожие статьи", "bài liên quan", "関連記事",
]
BEFORE = ["previous", "back", "←", "zurück", "anterior", "назад", "trước", "前へ"]
AFTER = ["next", "continue", "→", "weiter", "siguiente", "далее", "tiếp", "次へ"]
ROOTS = ["home", "docs", "start", "startseite", "hilfe", "inicio", "главная", "trang chủ", "ホーム"]
COOKIE_NOTICES = [
    r"(?:our pages|these docs|these pages|this site|this page|we) (?:set|use|store|rely on|save)s? cookies\b", r"(?:wir|diese seiten?|diese website) (?:nutz|verwend|setz|speicher)\w+ cookies\b",
    r"(?:usamos|guardamos|este sitio (?:usa|guarda)|esta página (?:usa|guarda)) cookies\b", r"(?:мы|сайт|здесь) [\w ]{0,20}файлы cookie\b", r"(?:chúng tôi|trang(?: này)?) (?:dùng|lưu|sử dụng) cookie\b", r"(?:当サイト|このページ|本サイト)は(?:cookie|クッキー)",
]


def _any(phrases: list[str]) -> str:
    return "(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=len, reverse=True)) + ")"


_URL = r"(?:https?://|git\+|mailto:)\S+"
_LINKED = r"\[[^\]]*\]\([^)]*\)"
_BULLET = re.compile(r"\s*(?:[-*+•–]|\d+[.)]|\[[ xX]\])\s+")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
_ONLY_LINK = re.compile(r"\[[^\]]*\]\([^)]*\)$")
_FENCE = re.compile(r"\s*(```+|~~~+)")
_WORDS = re.compile(r"[^\W\d_]+")
_TARGET = re.compile(r"\]\([^)]*\)")
_WEB = re.compile(r"https?://\S*")
_SPLIT = re.compile(r"\s+[|·•]\s+|\s*\|\s*")
#: Folders that advertising images come from.
_ADVERT = re.compile(r"!\[[^\]]*\]\((?:[^)]*/)?(?:ads?|advert|adverts|banners?|sponsors?|promo|promos)/[^)]*\)$", re.I)
_ENDS = ".!?。:;…"
_STOP = re.compile(rf"[{_ENDS}]$|[.!?。]\s")

_WHOLE = re.compile(
    "|".join(f"(?P<{name}{k}>{pattern})" for k, (name, pattern) in enumerate([
        ("skip", _any(SKIP)),
        ("search", rf"{_any(SEARCH)}\s*(?:⌘\s?k|ctrl\s?\+\s?k|/)?"),
        ("feedback", rf"{_any(FEEDBACK)}\s*[?？]?(?:\s*(?:[|/·,]\s*)?(?:[^\s|/·,.!?]{{1,6}}|a bit|not really)){{1,4}}"),
        ("edit", rf"{_any(EDIT)}(?:\s*[·:|–—-]?\s*{_URL})?"),
        ("follow", rf"{_any(FOLLOW)}\s*(?:✉|→|@\w+|ok)?"),
        ("version", r"v?\d+(?:\.\d+)*\s*\((?:latest|stable|current)\)(?:\s*[|·]?\s*v?\d+(?:\.\d+)*)*"),
        ("legal", r"(?:©|\(c\)|copyright)\s*(?:©\s*)?\d{4}(?:\s*[–-]\s*\d{4})?[\s,]+\S.*"),
        ("legal", r"\d{4} · \w[\w .&-]*"),
        ("pair", rf"{_any(BEFORE)}\s*:?\s.+\s(?:—|–|\||/|·)\s+{_any(AFTER)}\s*:?\s.+"),
        ("path", rf"{_any(ROOTS)}(?:\s+[»›>]\s+[^»›>]+)+"),
        ("path", rf"{_any(ROOTS)}(?:\s+/\s+[^/]+){{2,}}"),
    ]))
)
_COOKIES = re.compile("|".join(COOKIE_NOTICES))
_BY_PATH = re.compile(rf"(?:{_LINKED}|\S[^›»]*)(?:\s+[›»]\s+(?:{_LINKED}|[^›»]+))+$")
_LINKED_PATH = re.compile(rf"{_LINKED}\s+/\s+{_LINKED}\s+/\s+\S.*$")
_MENU, _CONSENT, _RELATED, _CONTENTS, _ONE = map(frozenset, (MENU, CONSENT, RELATED, CONTENTS, [*BEFORE, *AFTER]))
# the first two characters of what _WHOLE knows, by which most lines are told to be none of it; of shorter ones the first
_OPENINGS = frozenset(p[:2] for p in [*SKIP, *SEARCH, *FEEDBACK, *EDIT, *FOLLOW, *BEFORE, *ROOTS, "(c", "co", *(f"v{n}" for n in range(10))] if len(p) > 1)
_SIGNS = frozenset(["©", *(p for p in [*BEFORE, *AFTER] if len(p) == 1)])


_BEFORE_DRESS, _AFTER_DRESS = SPACES + ">*_+•-", SPACES + "*_"


#: Makes blanks of all bytes but letters.
LETTERS = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def words_of(lower: str) -> list[bytes] | list[str]:
    """The runs of letters of a text in lower case; as bytes if it has nothing but ASCII, which is faster."""
    if lower.isascii():
        return lower.encode().translate(LETTERS).split()
    return _WORDS.findall(lower)


def _hash(words: list[bytes] | list[str]) -> int:
    return xxhash.xxh3_64_intdigest((b" " if words and words[0].__class__ is bytes else " ").join(words)) >> 1


def line_key(line: str) -> tuple[int, int]:
    """The number of the line's words and a 63-bit hash of them; link targets, URLs and letter case aside."""
    if "](" in line:
        line = _TARGET.sub("]", line)
    if "://" in line:
        line = _WEB.sub(" ", line)
    words = words_of(line.lower())
    return len(words), _hash(words)


def own_key(stripped: str) -> int:
    """The key of a line that isn't counted per host, which is below 0: a hash of the line as it is."""
    return -(xxhash.xxh3_64_intdigest(stripped) >> 1 | 1)


def _role(line: str, stripped: str, lower: str) -> int:
    """The role of one line outside of code, without its surroundings; also given stripped, and that in lower case."""
    first = stripped[0]
    if first == "|" or first == "<" and stripped.startswith(("<t", "</t")):
        return TABLE
    if first == "#" and stripped.lstrip("#")[:1].isspace():
        title = stripped.lstrip("#").strip().lower().removesuffix(":").rstrip()
        if title in _RELATED or title in _CONTENTS and not stripped.startswith("# "):
            return OPENS_LIST
        return TITLE if stripped.startswith("# ") else HEADING
    if first == ">" and "documentation index" in stripped.lower() and stripped.lstrip("> ").startswith("#"):
        return INDEX
    bare = stripped.lstrip(_BEFORE_DRESS).rstrip(_AFTER_DRESS)
    links = bare.count("](")
    if links and bare.startswith("![") and _ADVERT.match(bare):
        return ADVERT
    plain = _LINK.sub(r"\1", bare).lower().lstrip() if links else lower.lstrip(_BEFORE_DRESS).rstrip(_AFTER_DRESS)
    if not plain:
        return TEXT
    opening = plain[:2] in _OPENINGS or plain[0] in _SIGNS or plain[0].isdecimal()
    cookies = "cookie" in plain or "クッキー" in plain
    parted = "|" in plain or "·" in plain or "•" in plain
    if not (links or opening or cookies or parted) and stripped[-1] in ".!?。":
        return QUOTE if first == ">" else TEXT  # a sentence, as most lines are
    plain = " ".join(plain.split())
    bulleted = _BULLET.match(line) is not None
    only_link = links == 1 and _ONLY_LINK.match(bare) is not None
    if not bulleted or only_link:
        if opening and (whole := _WHOLE.fullmatch(plain)):
            return ELEMENT[whole.lastgroup.rstrip("0123456789")]
        label = plain.removesuffix(":").rstrip()
        if label in _CONTENTS and not bulleted or label in _RELATED and plain != label:
            return OPENS_LIST
        if only_link and plain in _ONE:
            return OPENS_ONE
        if first != ">" and ("›" in bare or "»" in bare) and _BY_PATH.match(bare) and not _STOP.search(plain):
            return PATH
        if links > 1 and _LINKED_PATH.match(bare):
            return PATH
        if cookies and _COOKIES.match(plain):
            return COOKIES
    if links < 2 or "|" in bare or " · " in bare:
        parts = [p for p in _SPLIT.split(plain) if p] if parted else [plain]
    else:
        parts = [m.group(1).strip().lower() for m in _LINK.finditer(bare)]
    if links >= 2 and _LINK.sub("", bare).strip(" |·•,"):
        parts = [plain]
    if _MENU.issuperset(parts):
        return MENU_LINE
    if (len(parts) > 1 or not bulleted) and _CONSENT.issuperset(parts):
        return CONSENT_LINE
    if len(parts) > 2 and sum(p in _MENU for p in parts) * 2 > len(parts):
        return MENU_LINE
    if first == ">":
        return QUOTE
    if only_link:
        return LINK
    if not links and first not in "<{!`" and not _STOP.search(plain):
        return BULLET if bulleted else ITEM
    return TEXT


def read_line(line: str) -> tuple[int, int, str, list[bytes] | list[str] | None]:
    """(role, key, the stripped line in lower case, its words) of a line that isn't blank; no words if it has links or URLs."""
    stripped = line.strip()
    lower = stripped.lower()
    role = _role(line, stripped, lower)
    if "](" in lower or "://" in lower:
        words, (count, key) = None, line_key(stripped)
    else:
        words = words_of(lower)
        count, key = len(words), _hash(words)
    if role in (TABLE, TITLE):
        key = own_key(stripped)
    elif role == HEADING and count:
        key = (key ^ _HEADINGS) & ~1
    else:
        key = (key | 1 if count >= 3 else key & ~1) if count else own_key(stripped)
    return role, key, lower, words


def _read(line: str) -> tuple[int, int]:
    return read_line(line)[:2]


#: Parts the keys of headings from those of labels with the same words.
_HEADINGS = 0x5bd1e9955bd1e994
_SEPARATOR = re.compile(r"\|?\s*:?-+:?\s*(?:\|\s*:?-*:?\s*)*$")


def _blocks(lines: list[str], roles: list[int], keys: list[int]) -> list[int]:
    """The key of each block, 0 where its lines' keys say as much; rows that are no table's get keys of sentences."""
    out, k, n = [], 0, len(roles)
    while k < n:
        if roles[k] == BLANK:
            k += 1
            continue
        end = k
        while end < n and roles[end] != BLANK:
            end += 1
        here = roles[k:end]
        rows = [i for i in range(k, end) if roles[i] == TABLE] if TABLE in here else []
        if rows and not any(lines[i].lstrip()[0] == "<" or _SEPARATOR.match(lines[i].strip()) for i in rows):
            for i in rows:
                words, key = line_key(lines[i].strip())
                if words >= 3:
                    keys[i] = key | 1
        key = 0
        if (end - k > 1 or rows) and CODE not in here and TITLE not in here and here.count(HEADING) < end - k and not all(x > 0 and x & 1 for x in keys[k:end]):
            words, whole = line_key("\n".join(lines[k:end]))
            key = whole | 1 if words >= 3 else 0
        out.append(key)
        k = end
    return out


#: Chrome recurs, so most of its lines are read once per worker.
_role_and_key = lru_cache(maxsize=200_000)(_read)


def analyse(text: str | None, known: list | None = None) -> tuple[list[int], list[int], list[int]]:
    """(roles, keys) of the lines of a page, and the keys of its blocks with those of its elements behind them.

    A key is 0 in blank lines and code, and below 0 where it isn't counted per host. Keys of sentences (three
    words or more) and of labels are told apart by their last bit; those of elements are small numbers. A list
    given as ``known`` gets what was found on the way for each line: that in lower case and its words, or None.
    """
    if not text:
        return [], [], []
    lines = text.split("\n")
    roles, keys, fence = [], [], ""
    marks = [k for k, line in enumerate(lines) if "```" in line or "~~~" in line] if "```" in text or "~~~" in text else []
    closing = set()
    for k in marks:
        mark = _FENCE.match(lines[k])
        if mark and fence and mark.group(1)[0] == fence:
            closing.add(k)
            fence = ""
        elif mark and not fence:
            fence = mark.group(1)[0]
    last_close, fence = max(closing, default=-1), ""
    for k, line in enumerate(lines):
        if not line or line.isspace():
            roles.append(CODE if fence else BLANK)
            keys.append(0)
            if known is not None:
                known.append(None)
            continue
        # a fence that nothing closes holds no code, as the page's end would belong to it
        mark = _FENCE.match(line) if k <= last_close else None
        if fence or mark:
            if mark and fence and mark.group(1)[0] == fence:
                fence = ""
            elif mark and not fence:
                fence = mark.group(1)[0]
            roles.append(CODE)
            keys.append(0)
            if known is not None:
                known.append(None)
            continue
        if known is None:
            role, key = _role_and_key(line) if len(line) <= 200 else _read(line)
        elif len(line) > 60:
            role, key, lower, words = read_line(line)
            known.append((lower, words) if words is not None and "`" not in lower else None)
        else:
            role, key = _role_and_key(line)
            known.append(None)
        roles.append(role)
        keys.append(key)
    return roles, keys, [*_blocks(lines, roles, keys), *{r for r in roles if r >= FIRST_ELEMENT}, *[COLUMN] * _has_column(roles)]


def _has_column(roles: list[int]) -> bool:
    """Whether the page begins with a column of labels and links, elements aside."""
    title = roles.index(TITLE) if TITLE in roles else -1
    for k, role in enumerate(roles):
        if role in ENTRIES:
            end = k
            while end < len(roles) and roles[end] != BLANK:
                end += 1
            return _sidebar(roles, k, end, title) > 0
        if role < FIRST_ELEMENT and role != BLANK:
            return False
    return False


def _sidebar(roles: list[int], first: int, end: int, title: int) -> int:
    """Where the column of labels and links that begins at ``first`` ends, if it is a sidebar; else -1.

    Before the title any column of three or more is one, whichever pages it names; without a title it must
    mix links, bulleted and plain labels, as the page's own list doesn't, and a body must follow.
    """
    last = first
    while last < end and roles[last] in ENTRIES:
        last += 1
    if last - first < 3:
        return -1
    mixed = len(set(roles[first:last])) > 1 and any(r in (TEXT, HEADING, CODE, TABLE) for r in roles[last:])
    return last if first < title or mixed else -1


def chrome_lines(roles: list[int], keys: list[int], blocks: list[int], recurring: set[int]) -> list[int]:
    """The numbers of the lines that belong to the site, from what ``analyse`` gave and the host's recurring keys."""
    n, out = len(roles), []
    title = roles.index(TITLE) if TITLE in roles else -1
    started = False  # whether the main body has begun
    k, whole = 0, iter(blocks)
    while k < n:
        if roles[k] == BLANK:
            k += 1
            continue
        end = k
        while end < n and roles[end] != BLANK:
            end += 1
        if next(whole) in recurring:
            out += range(k, end)
            k = end
            continue
        items = [i for i in range(k, end) if roles[i] in ENTRIES or roles[i] == MENU_LINE]
        menu = len(items) > 1 and sum(keys[i] in recurring or roles[i] == MENU_LINE and MENU_LINE in recurring for i in items) * 2 > len(items)
        state, body, aside = "", False, -1
        for i in range(k, end):
            role = roles[i]
            if role in ENTRIES and i > aside and not (started or body or state) and COLUMN in recurring:
                aside = _sidebar(roles, i, end, title)
            if role >= FIRST_ELEMENT and role in recurring:
                out.append(i)
                state = OPENS.get(role, "")
            elif keys[i] & 1 and keys[i] in recurring:
                out.append(i)
            elif state == "list" and role in ENTRIES or state == "index" and role in (QUOTE, TEXT):
                out.append(i)
            elif state == "one" and role in ENTRIES:
                out.append(i)
                state = ""
            elif state in ("cookies", "consent") and role in (TEXT, *ENTRIES):
                out.append(i)
                state = "consent" if state == "cookies" else ""
            elif role in ENTRIES and (menu and not body and keys[i] > 0 or i < aside):
                out.append(i)
            else:
                state, body = "", True
        started |= body
        k = end
    return out + _headings(roles, keys, set(out), recurring)


def _headings(roles: list[int], keys: list[int], out: set[int], recurring: set[int]) -> list[int]:
    """The recurring headings with nothing but chrome up to the next heading."""
    found, below, left = [], False, False  # whether the section has lines, and lines that stay
    for i in range(len(roles) - 1, -1, -1):
        if roles[i] == BLANK:
            continue
        if roles[i] in (HEADING, TITLE):
            if i not in out and roles[i] == HEADING and keys[i] in recurring and below and not left:
                found.append(i)
            below = left = False
        else:
            below = True
            left |= i not in out
    return found


LINES = T.StructType([
    T.StructField("body_id", T.LongType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("page_key", T.StringType()),
    T.StructField("roles", T.BinaryType()),
    T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("blocks", T.ArrayType(T.LongType())),
])


def packed(roles: list[int], keys: list[int], blocks: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    return bytes(roles), np.array(keys, dtype=np.int64), np.array(blocks, dtype=np.int64)


class Hosts:
    """The recurring keys of the hosts that a task comes across, a bounded number of them at a time."""

    HELD = 256

    def __init__(self):
        self.held: dict[str | None, set[int]] = {}

    def keys(self, source: str | None, recurring: np.ndarray | None) -> set[int]:
        if source not in self.held:
            if len(self.held) >= self.HELD:
                self.held.clear()
            self.held[source] = set() if recurring is None else set(recurring.tolist())
        return self.held[source]


def _analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = [packed(*analyse(text)) for text in batch.pop("markdown")]
        for name, column in zip(("roles", "keys", "blocks"), zip(*parts) if parts else [()] * 3):
            batch[name] = pd.Series(column, index=batch.index, dtype=object)
        yield batch


def analysed_pages(pages: DataFrame) -> DataFrame:
    """One row per page with the role and key of each of its lines; null texts have none."""
    return pages.where("body_id IS NOT NULL").select("body_id", "source_name", "page_key", "markdown").mapInPandas(_analyse, LINES)


def recurring_keys(analysed: DataFrame, sentence_share: float = SENTENCE_SHARE, label_share: float = LABEL_SHARE, element_share: float = ELEMENT_SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(source_name, recurring): the keys on a large share of a host's pages, as one array per host.

    The array is bounded by the lines of a page divided by the smallest share, however many pages there are.
    A page delivered twice counts once; without a page_key each body_id is a page of its own.
    """
    page = F.coalesce(F.concat(F.lit("p"), "page_key"), F.concat(F.lit("b"), F.col("body_id").cast("string")))
    # keys below 64 are elements; parted by page before keys are told apart, so that whole arrays are moved and no group is collected
    one = analysed.where("source_name IS NOT NULL").select("source_name", page.alias("page"), F.concat("keys", "blocks").alias("keys")).repartition("source_name", "page")
    pages = one.select("source_name", "page").distinct().groupBy("source_name").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        one.select("source_name", "page", F.explode(F.array_distinct("keys")).alias("key")).where("key > 0").distinct()
        .groupBy("source_name", "key").agg(F.count(F.lit(1)).alias("on"))
        .where(F.col("on") >= least_pages)
    )
    share = F.when(F.col("key") < 64, element_share).when(F.col("key").bitwiseAND(F.lit(1)) == 1, sentence_share).otherwise(label_share)
    return (
        counts.join(pages, "source_name").where(F.col("on") >= F.col("pages") * share)
        .groupBy("source_name").agg(F.collect_list("key").alias("recurring"))
    )


def with_recurring(analysed: DataFrame) -> DataFrame:
    """The analysed pages with their host's array of recurring keys, null where none recurs."""
    return analysed.drop("page_key").join(broadcast_if_small(cut(recurring_keys(analysed))), "source_name", "left")


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hosts = Hosts()
    for batch in batches:
        rows = []
        for body, source, roles, keys, blocks, recurring in zip(*(batch[c] for c in ("body_id", "source_name", "roles", "keys", "blocks", "recurring"))):
            rows += [(body, k) for k in chrome_lines(list(roles), keys.tolist(), blocks.tolist(), hosts.keys(source, recurring))]
        yield pd.DataFrame(rows, columns=["body_id", "line_no"])


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(body_id, line_no) of every non-blank line that isn't part of its page's main body.

    A page without a source has no host to recur on, so all its lines stay. Null, empty and blank texts
    have no row. Rows delivered under two body_ids are listed under both; a repeated row counts once.
    """
    rows = with_recurring(cut(analysed_pages(pages)))
    return rows.mapInPandas(_decide, "body_id bigint, line_no bigint").distinct()


def main_bodies(pages: DataFrame) -> DataFrame:
    """The pages with ``markdown`` cut down to the main body; all other columns stay."""
    drop = boilerplate_lines(pages).groupBy("body_id").agg(F.collect_set("line_no").alias("__drop"))
    kept = F.filter(F.split("markdown", "\n"), lambda line, i: F.col("__drop").isNull() | ~F.array_contains("__drop", i.cast("bigint")))
    return pages.join(drop, "body_id", "left").withColumn("markdown", F.array_join(kept, "\n")).drop("__drop")
