"""Search strings to filters and terms: dates and task phrases in plain words, then fields.

Plain Python on the driver: a query is a line of text. `now` is a parameter, days are those
of `zone`, weeks begin on `first_weekday` (0 Monday, 6 Sunday).
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo


@dataclass(frozen=True)
class Filters:
    tags: tuple[str, ...] = ()
    status: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    exts: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    frontmatter: tuple[tuple[str, str], ...] = ()
    after: float | None = None
    before: float | None = None
    task: str | None = None  # any, todo or done

    def __bool__(self) -> bool:
        return self != Filters()


@dataclass(frozen=True)
class Query:
    raw: str
    filters: Filters = field(default_factory=Filters)
    terms: tuple[str, ...] = ()

    @property
    def text(self) -> str:
        return " ".join(self.terms)


@dataclass(frozen=True)
class Facet:
    kind: str  # time, structured or lexsem
    label: str
    value: str

    @property
    def id(self) -> str:
        return f"{self.label}:{self.value}"


@dataclass(frozen=True)
class Clock:
    now: datetime
    first_weekday: int = 6

    @classmethod
    def at(cls, epoch: float, zone: str = "UTC", first_weekday: int = 6) -> Clock:
        return cls(datetime.fromtimestamp(epoch, ZoneInfo(zone)), first_weekday)

    def day(self, back: int = 0) -> datetime:
        return self.now.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=back)

    def week(self, back: int = 0) -> datetime:
        return self.day((self.now.weekday() - self.first_weekday) % 7 + 7 * back)

    def month(self, back: int = 0) -> datetime:
        n = self.now.year * 12 + self.now.month - 1 - back
        return self.day().replace(year=n // 12, month=n % 12 + 1, day=1)

    def year(self, back: int = 0) -> datetime:
        return self.day().replace(year=self.now.year - back, month=1, day=1)


# Phrases for periods, as (phrases, unit, first back, whether it ends at the next).
PERIODS = [
    (("今日", "本日", "today"), "day", 0, False),
    (("昨日", "yesterday"), "day", 1, True),
    (("今週", "this week"), "week", 0, False),
    (("先週", "last week", "先週分"), "week", 1, True),
    (("今月", "this month"), "month", 0, False),
    (("先月", "last month"), "month", 1, True),
    (("今年", "this year"), "year", 0, False),
    (("去年", "昨年", "last year"), "year", 1, True),
    (("最近", "recently", "このごろ"), "recent", 7, False),
]
# Phrases for task states; the first list with a hit decides.
TASKS = [(("未完了", "未対応", "やり残し", "todo", "to-do"), "todo"), (("完了済", "対応済", "済みのタスク", "done のタスク"), "done")]
# Fixed value: "the last N days" in Japanese and English.
DAYS = re.compile(r"(?:過去|直近)?\s*(\d+)\s*(?:日(?:以内|間|前)?)|last\s+(\d+)\s+days?", re.I)
# Fields with their names, and the words of `is:`.
FIELDS = {"tag": "tags", "tags": "tags", "status": "status", "path": "paths", "in": "paths", "ext": "exts", "lang": "langs", "code": "langs"}
DATES = {"modified", "updated", "mtime", "date"}
STATES = {"task": "any", "todo": "todo", "open": "todo", "unchecked": "todo", "done": "done", "checked": "done", "closed": "done"}


def words(raw: str) -> list[str]:
    """Parts between spaces; quotation marks keep spaces and are dropped."""
    out = [[]]
    quoted = False
    for piece in re.split('([" ])', raw):
        if piece == '"':
            quoted = not quoted
        elif piece == " " and not quoted:
            out.append([])
        else:
            out[-1].append(piece)
    return [w for w in map("".join, out) if w]


def date_range(text: str, zone) -> tuple[float, float] | None:
    """[start, end) of `Y`, `Y-M` or `Y-M-D`; months and days beyond their range roll over."""
    numbers = [int(p) for p in text.split("-") if re.fullmatch(r"[+-]?\d+", p)]
    if not numbers:
        return None

    def moment(y: int, m: int = 1, d: int = 1) -> datetime:
        months = y * 12 + m - 1
        return datetime(months // 12, months % 12 + 1, 1, tzinfo=zone) + timedelta(days=d - 1)

    try:
        if len(numbers) >= 3:
            start = moment(*numbers[:3])
            end = start + timedelta(days=1)
        elif len(numbers) == 2:
            start, end = moment(*numbers), moment(numbers[0], numbers[1] + 1)
        else:
            start, end = moment(numbers[0]), moment(numbers[0] + 1)
    except (ValueError, OverflowError):
        return None
    return start.timestamp(), end.timestamp()


def parse(raw: str, clock: Clock) -> Query:
    """Fields `key:value` to filters, the rest to terms."""
    f, terms = Filters(), []
    for word in words(raw):
        key, colon, value = word.partition(":")
        if "://" in word or not colon or not key or not value or not all(c.isalnum() or c == "_" for c in key):
            terms.append(word)
            continue
        key = key.lower()
        if key in FIELDS:
            name = FIELDS[key]
            v = value.lower().replace(".", "") if name == "exts" else value.lower() if name == "langs" else value
            f = replace(f, **{name: getattr(f, name) + (v,)})
        elif key == "is":
            f = replace(f, task=STATES.get(value.lower(), f.task))
        elif key in DATES:
            m = re.match(r"[<>]=?", value)
            op = m.group()[0] if m else ""
            span = date_range(value[m.end() :] if m else value, clock.now.tzinfo)
            if span:
                f = replace(f, after=f.after if op == "<" else span[0], before=f.before if op == ">" else span[1])
        else:
            f = replace(f, frontmatter=f.frontmatter + ((key, value),))
    return Query(raw, f, tuple(terms))


def plan(raw: str, clock: Clock) -> Query:
    """parse() after plain words for dates and tasks were understood; written fields go first."""
    rest, after, before = raw, None, None
    for phrases, unit, back, ends in PERIODS:
        phrase = next((p for p in phrases if p in rest), None)
        if phrase is None:
            continue
        rest = rest.replace(phrase, " ", 1)
        start = clock.now - timedelta(days=back) if unit == "recent" else getattr(clock, unit)(back)
        after = start.timestamp() if after is None else after
        if ends and before is None:
            before = getattr(clock, unit)(back - 1).timestamp()
    if m := DAYS.search(rest):
        rest = rest[: m.start()] + " " + rest[m.end() :]
        after = (clock.now - timedelta(days=int(m.group(1) or m.group(2)))).timestamp() if after is None else after
    task = next((state for phrases, state in TASKS if any(p in rest for p in phrases)), None)
    q = parse(rest, clock)
    f = q.filters
    f = replace(f, after=after if f.after is None else f.after, before=before if f.before is None else f.before, task=f.task or task)
    return Query(raw, f, q.terms)


# Labels of facets.
TIME, WORDS, TASK = "時間軸", "全文+意味", "タスク"
LABELS = [("tags", "タグ"), ("status", "状態"), ("paths", "パス"), ("exts", "拡張子"), ("langs", "言語")]


def _period(f: Filters, zone) -> str:
    day = lambda t, form: datetime.fromtimestamp(t, zone).strftime(form)
    if f.before is None:
        return f"{day(f.after, '%Y-%m-%d')} 以降"
    if f.before - f.after <= 32 * 86_400:
        return day(f.after, "%Y-%m")
    return f"{day(f.after, '%Y-%m-%d')}–{day(f.before, '%Y-%m-%d')}"


def _task_label(state: str) -> str:
    return "完了" if state == "done" else "未完了"


def interpret(q: Query, clock: Clock) -> list[Facet]:
    """How a query was understood; each facet can be taken back by its id."""
    f = q.filters
    out = [Facet("time", TIME, _period(f, clock.now.tzinfo))] if f.after is not None else []
    out += [Facet("structured", label, v) for name, label in LABELS for v in getattr(f, name)]
    out += [Facet("structured", TASK, _task_label(f.task))] if f.task else []
    out += [Facet("structured", k, v) for k, v in f.frontmatter]
    return out + ([Facet("lexsem", WORDS, q.text)] if q.terms else [])


def without(q: Query, facets: set[str], clock: Clock) -> Query:
    """The query without the filters of these facets."""
    f = q.filters
    stay = lambda label, values: tuple(v for v in values if f"{label}:{v}" not in facets)
    new = {name: stay(label, getattr(f, name)) for name, label in LABELS}
    new["frontmatter"] = tuple((k, v) for k, v in f.frontmatter if f"{k}:{v}" not in facets)
    if f.after is not None and f"{TIME}:{_period(f, clock.now.tzinfo)}" in facets:
        new |= {"after": None, "before": None}
    if f.task and f"{TASK}:{_task_label(f.task)}" in facets:
        new["task"] = None
    return Query(q.raw, replace(f, **new), q.terms)


# Groups of words of one meaning, for relaxed queries.
ALIASES = [
    ["ログイン", "サインイン", "認証", "auth", "login"],
    ["登録", "サインアップ", "signup", "アカウント作成"],
    ["検索", "サーチ", "search"],
    ["埋め込み", "ベクトル", "embedding"],
    ["高速化", "パフォーマンス", "performance", "最適化", "速い"],
    ["図", "ダイアグラム", "チャート", "図表", "diagram", "mermaid"],
    ["画像", "イメージ", "image", "スクリーンショット"],
    ["非同期", "async", "並行", "並列"],
    ["テスト", "test", "アサーション", "検証"],
    ["データベース", "DB", "database", "SQL"],
    ["設定", "config", "コンフィグ", "構成"],
    ["生成AI", "LLM", "AI", "エージェント"],
    ["フロントエンド", "frontend", "フロント"],
    ["ビルド", "build", "コンパイル", "compile", "コンパイラ"],
    ["リファクタリング", "refactor", "リファクタ", "改修"],
    ["移行", "マイグレーション", "migration", "モダナイズ", "刷新"],
    ["重複", "duplicate", "コピペ", "similarity"],
    ["決済", "支払い", "payment", "課金", "stripe"],
    ["圧縮", "compress", "gzip"],
    ["計測", "測定", "metrics", "lighthouse"],
    ["定期実行", "cron", "スケジューラ"],
    ["キュー", "queue", "ジョブ"],
    ["キャッシュ", "cache"],
    ["描画", "レンダリング", "render", "レンダラ", "レイアウト"],
    ["エディタ", "editor", "vscode"],
    ["ターミナル", "terminal", "CLI", "コマンドライン"],
    ["正規表現", "regex"],
    ["例外", "exception", "エラー処理", "エラーハンドリング", "try"],
    ["環境構築", "セットアップ", "setup", "初期設定", "環境"],
    ["書き捨て", "スクラップ", "使い捨て"],
    ["履歴", "バージョン管理", "git", "コミット"],
    ["言語サーバ", "LSP", "language server"],
    ["リソース管理", "リソース解放", "using", "dispose"],
    ["文字起こし", "音声認識", "transcribe"],
    ["雛形", "テンプレート", "template", "スターター", "starter", "ボイラープレート"],
    ["自作", "スクラッチ", "作ってみた", "自前"],
    ["監視", "watch", "モニタリング", "オブザーバ"],
    ["通知", "notification", "webhook"],
    ["要約", "サマリ", "summary"],
    ["翻訳", "translate", "i18n"],
    ["並べ替え", "ソート", "sort", "ランキング"],
    ["ストレージ", "storage", "永続化", "保存"],
    ["トークン", "token"],
    ["型", "type", "型定義"],
    ["補完", "サジェスト", "オートコンプリート"],
]


def expand(query: str, extra: list[list[str]] = ()) -> list[str]:
    """The other words of every group of which a word stands in the query, each once."""
    low = query.lower()
    found: dict[str, None] = {}
    for group in [*ALIASES, *extra]:
        there = [w for w in group if w.lower() in low]
        if there:
            found |= dict.fromkeys(w for w in group if w.lower() not in low)
    return list(found)


def load_aliases(root: str, folder: str = ".inkwell") -> list[list[str]]:
    """Groups of <root>/<folder>/aliases.json; groups of one and malformed files are dropped."""
    try:
        with open(os.path.join(root, folder, "aliases.json"), encoding="utf-8") as f:
            return [g for g in json.load(f) if len(g) >= 2]
    except (OSError, ValueError, TypeError):
        return []
