"""Extraction jobs over a table of HTML pages: fixtures and standings.

Pages are rows ``(league, season_year, url, html)``; every page is parsed by
JVM-side regular expressions and higher-order functions (no Python parser),
so extraction runs as a narrow map over page partitions. Rules:

fixtures - the first table whose id contains ``sched``, else the first whose
class contains ``sched``, else the first with more than 5 rows whose first
row has ``date``, ``score`` and ``home`` or ``away`` headers. Headers map to
fields by substring (a later header overwrites an earlier one), ``squad`` /
``team`` headers are the fallback for the two teams, positional defaults
0..6 fill the rest. Rows shorter than the mapped columns, rows with a team
name missing or shorter than 2, and repeated header rows are skipped. A
team cell's text is its link text when it has a link.

standings - tables hidden in HTML comments are appended after the visible
ones; the first table with a ``pos|rank|w|wins`` header and a ``pts|points``
header that yields at least one row wins; cells are read by ``data-stat``
(points|pts, games|matches|games_played, ...), integers only when all
digits; fallbacks: team = cell 1, played = cell 2, points = last cell.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S

TABLE_RE = r"(?is)<table\b[^>]*>.*?</table>"
ROW_RE = r"(?is)<tr\b[^>]*>.*?</tr>"
CELL_RE = r"(?is)<t[hd]\b[^>]*>.*?</t[hd]>"
COMMENT_RE = r"(?s)<!--(.*?)-->"

# Entities: numeric ones by their code, named ones by the standard table.
ENTITY_RE = r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def texts_of(cells: Column) -> Column:
    """An array of cells' texts: tags removed, entities decoded, surrounding whitespace stripped.

    A pass for each step: where a step reads its input twice, that is a finished text, not
    a regular expression to be evaluated again.
    """
    plain = F.transform(cells, lambda c: F.regexp_replace(c, r"(?s)<[^>]*>", ""))
    decoded = F.transform(plain, lambda t: F.when(t.contains("&"), unescape(t)).otherwise(t))
    return F.transform(decoded, S.strip_ws)


def text_of(html: Column) -> Column:
    """The text of one cell (see ``texts_of``)."""
    return F.get(texts_of(F.array(html)), F.lit(0))


def _entity(e: Column) -> Column:
    """The character of one entity (with & and ;), itself if it names none."""
    names = F.create_map(*[F.lit(x) for n, c in sorted(name2codepoint.items()) for x in (f"&{n};", chr(c))])
    number = F.when(F.lower(e).startswith("&#x"), F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "#([0-9]+);", 1)).try_cast("bigint")

    def char(n):
        bad = (n <= 0) | (n > 0x10FFFF) | ((n >= 0xD800) & (n <= 0xDFFF))
        return F.when(bad, F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    return F.when(e.startswith("&#"), S.once(number, char)).otherwise(F.coalesce(names[e], e))


def unescape(t: Column) -> Column:
    """Text with its entities decoded, each once."""
    pieces = F.regexp_extract_all(t, F.lit(rf"(?s){ENTITY_RE}|[^&]+|&"), 0)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("&") & (F.length(p) > 1), _entity(p)).otherwise(p)), "")


def _cells(row: Column) -> Column:
    return F.regexp_extract_all(row, F.lit(CELL_RE), 0)


def _rows(table: Column) -> Column:
    return F.regexp_extract_all(table, F.lit(ROW_RE), 0)


def _open_tag(table: Column) -> Column:
    return F.lower(F.regexp_extract(table, r"(?is)^<table\b[^>]*>", 0))


def _attr(tag: Column, name: str) -> Column:
    """Value of the attribute of exactly this name: quoted either way, or bare."""
    found = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(found, r"""^["']|["']$""", "")


# ------------------------------------------------------------ fixtures

def _header_texts(table: Column) -> Column:
    first = F.try_element_at(_rows(table), F.lit(1))
    return F.transform(_cells(F.coalesce(first, F.lit(""))), lambda c: F.lower(text_of(c)))


def _pick_fixture_table(html: Column) -> Column:
    tables = F.regexp_extract_all(html, F.lit(TABLE_RE), 0)
    by_id = F.filter(tables, lambda t: F.lower(_attr(_open_tag(t), "id")).contains("sched"))
    by_class = F.filter(tables, lambda t: F.exists(F.split(F.lower(_attr(_open_tag(t), "class")), r"\s+"),
                                                   lambda c: c.contains("sched")))

    def looks_like(t):
        h = _header_texts(t)
        return ((F.size(_rows(t)) > 5) & F.array_contains(h, "date") & F.array_contains(h, "score")
                & (F.array_contains(h, "home") | F.array_contains(h, "away")))

    by_header = F.filter(tables, looks_like)
    return F.coalesce(F.try_element_at(by_id, F.lit(1)), F.try_element_at(by_class, F.lit(1)),
                      F.try_element_at(by_header, F.lit(1)))


def _classify(h: Column) -> Column:
    return (F.when(h.contains("date"), "date").when(h.contains("time"), "time").when(h.contains("home"), "home")
            .when(h.contains("away") | h.contains("visitor"), "away")
            .when(h.contains("score") | h.contains("result"), "score")
            .when(h.contains("attendance"), "attendance").when(h.contains("venue"), "venue"))


def _last_index(headers: Column, pred) -> Column:
    idx = F.transform(headers, lambda h, i: F.when(pred(h), i))
    return F.array_max(F.filter(idx, lambda i: i.isNotNull()))


def extract_fixtures(pages: DataFrame) -> DataFrame:
    """Pages ``(league, season_year, html)`` -> raw match rows as in the scraper's output."""
    p = pages.select("league", "season_year", _pick_fixture_table(F.col("html")).alias("_t"))
    p = p.withColumn("_rows", _rows(F.col("_t")))  # no table, no rows: a filter would evaluate the pick twice
    p = p.withColumn("_h", F.transform(_cells(F.coalesce(F.try_element_at("_rows", F.lit(1)), F.lit(""))),
                                       lambda c: F.lower(text_of(c))))
    cols = {}
    for key in ("date", "time", "home", "away", "score", "attendance", "venue"):
        cols[key] = _last_index(F.col("_h"), lambda h, k=key: _classify(h) == k)
    p = p.select("*", *[v.alias(f"_m_{k}") for k, v in cols.items()])
    # squad/team fallback when no header mapped to 'home'
    st = F.filter(F.transform("_h", lambda h, i: F.when(h.isin("squad", "team"), i)), lambda i: i.isNotNull())
    no_home = F.col("_m_home").isNull()
    p = (p.withColumn("_m_away", F.when(no_home & (F.size(st) >= 2), F.element_at(st, -1)).otherwise(F.col("_m_away")))
          .withColumn("_m_home", F.when(no_home, F.try_element_at(st, F.lit(1))).otherwise(F.col("_m_home"))))
    mapped = F.array(*[F.col(f"_m_{k}") for k in cols])
    p = p.withColumn("_need", F.coalesce(F.array_max(F.filter(mapped, lambda x: x.isNotNull())), F.lit(-1)) + 1)
    defaults = {"date": 0, "time": 1, "home": 2, "away": 3, "score": 4, "venue": 5, "attendance": 6}

    def cell(c, k):
        i = F.coalesce(F.col(f"_m_{k}"), F.lit(defaults[k]))
        return F.when(i < F.size(c), F.element_at(c, (i + 1).cast("int")))

    def team(c, k):
        x = cell(c, k)
        return F.when(x.rlike(r"(?is)<a\b"), F.regexp_extract(x, r"(?is)<a\b[^>]*>(.*?)</a>", 1)).otherwise(x)

    # Parse every body row of the page in array passes and filter there:
    # each row's cells are extracted once, and no row predicate is pushed below
    # (and re-evaluated before) the parsing.
    cells = F.filter(F.transform(F.slice("_rows", 2, 1 << 30), lambda r: _cells(r)),
                     lambda c: F.size(c) >= F.col("_need"))
    fields = {"date": "date_text", "time": "time", "home": "home_team", "away": "away_team", "score": "score", "venue": "venue", "attendance": "attendance"}
    texts = F.transform(cells, lambda c: texts_of(F.array(*[team(c, k) if k in ("home", "away") else cell(c, k) for k in fields])))
    parsed = F.transform(texts, lambda t: F.struct(*[F.coalesce(F.get(t, F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(fields.values())]))
    p = p.withColumn("_parsed", parsed)

    def keep(x):
        h, a = x.home_team, x.away_team
        return ((F.length(h) >= 2) & (F.length(a) >= 2)
                & ~F.lower(h).isin(*C.HOME_HEADER_WORDS) & ~F.lower(a).isin(*C.AWAY_HEADER_WORDS))

    rows = p.select("league", "season_year", F.explode(F.filter("_parsed", keep)).alias("x"))
    out = rows.select("league", S.season_label("season_year").alias("season"),
                      S.parse_date_text("x.date_text").alias("date"), "x.time", "x.home_team", "x.away_team",
                      "x.score", "x.venue", "x.attendance")
    sc = S.parse_score("score")
    return (out.withColumn("home_goals", sc.home_goals).withColumn("away_goals", sc.away_goals)
               .withColumn("result", S.result_label("home_goals", "away_goals")))


# ------------------------------------------------------------ standings

def _all_tables(html: Column) -> Column:
    visible = F.regexp_extract_all(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), F.lit(TABLE_RE), 0)
    comments = F.filter(F.regexp_extract_all(html, F.lit(COMMENT_RE), 1), lambda c: c.contains("<table"))
    hidden = F.flatten(F.transform(comments, lambda c: F.regexp_extract_all(c, F.lit(TABLE_RE), 0)))
    return F.concat(visible, hidden)


def _section(table: Column, tag: str) -> Column:
    return F.regexp_extract(table, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def _has_section(table: Column, tag: str) -> Column:
    return table.rlike(rf"(?is)<{tag}\b")


def _standings_ok(t: Column) -> Column:
    heads = F.transform(F.regexp_extract_all(_section(t, "thead"), F.lit(r"(?is)<th\b[^>]*>.*?</th>"), 0),
                        lambda c: F.lower(text_of(c)))
    joined = F.array_join(heads, " ")
    body_rows = F.filter(_rows(_section(t, "tbody")), lambda r: F.size(_cells(r)) > 0)
    return (_has_section(t, "thead") & _has_section(t, "tbody")
            & F.exists(heads, lambda h: h.isin("pos", "rank", "w", "wins"))
            & (joined.contains("pts") | joined.contains("points")) & (F.size(body_rows) > 0))


def _stat(cells: Column, stat: str) -> Column:
    """Text of the first ``td`` whose data-stat equals ``stat`` (null when absent)."""
    hit = F.filter(cells, lambda c: c.rlike(r"(?is)^<td\b") & (_attr(F.regexp_extract(c, r"(?is)^<td\b[^>]*>", 0),
                                                                      "data-stat") == stat))
    return text_of(F.try_element_at(hit, F.lit(1)))


def _digits(x: Column) -> Column:
    return F.when(x.rlike(r"^[0-9]+$"), x.try_cast("bigint"))


def _truthy(x: Column) -> Column:
    """Python-style 'x or ...': null and '' are false."""
    return F.when(x != "", x)


def extract_standings(pages: DataFrame) -> DataFrame:
    """Pages ``(league, season, html)`` -> standings rows of the first qualifying table."""
    p = pages.select("league", "season", F.try_element_at(F.filter(_all_tables(F.col("html")), _standings_ok),
                                                          F.lit(1)).alias("_t"))
    r = p.select(
        "league", "season", F.posexplode(_rows(_section(F.col("_t"), "tbody"))).alias("ordinal", "_row"))
    r = r.withColumn("_c", _cells(F.col("_row"))).where(F.size("_c") > 0)
    cols = F.transform(F.col("_c"), lambda c: text_of(c))
    th_row = F.filter(F.col("_c"), lambda c: c.rlike(r"(?is)^<th\b") & (_attr(F.regexp_extract(c, r"(?is)^<th\b[^>]*>", 0), "scope") == "row"))
    team_cell = F.coalesce(F.try_element_at(F.filter(F.col("_c"), lambda c: c.rlike(r"(?is)^<td\b") & (
        _attr(F.regexp_extract(c, r"(?is)^<td\b[^>]*>", 0), "data-stat") == "team")), F.lit(1)),
        F.try_element_at(th_row, F.lit(1)))
    team = F.when(team_cell.isNotNull(), text_of(team_cell))
    pts = F.coalesce(_truthy(_stat(F.col("_c"), "points")), _stat(F.col("_c"), "pts"))
    played = F.coalesce(_truthy(_stat(F.col("_c"), "games")), _truthy(_stat(F.col("_c"), "matches")),
                        _stat(F.col("_c"), "games_played"))
    last = F.element_at(cols, -1)
    out = r.select(
        "league", "season", (F.col("ordinal") + 1).cast("bigint").alias("ordinal"),
        F.coalesce(_truthy(team), F.when(F.size(cols) > 1, F.element_at(cols, 2)), F.lit("")).alias("team"),
        F.coalesce(_digits(played), F.when(F.size(cols) > 2, _digits(F.element_at(cols, 3)))).alias("played"),
        _digits(_stat(F.col("_c"), "wins")).alias("wins"), _digits(_stat(F.col("_c"), "draws")).alias("draws"),
        _digits(_stat(F.col("_c"), "losses")).alias("losses"),
        _digits(_stat(F.col("_c"), "goals_for")).alias("goals_for"),
        _digits(_stat(F.col("_c"), "goals_against")).alias("goals_against"),
        F.coalesce(_digits(pts), _digits(last)).alias("points"))
    return out


# ------------------------------------------------------------ page builders (test inputs)

def _esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def fixtures_pages(matches: DataFrame) -> DataFrame:
    """One fixtures page per (league, season) from a match table: <table id="sched_all">,
    header Date/Time/Home/Score/Away/Attendance/Venue, team cells as links, one
    repeated header row and one row cut short. Builds test input only."""
    td = lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))
    link = lambda x: F.concat(F.lit('<td><a href="/squads/'), S.slugify(x), F.lit('">'), _esc(x), F.lit("</a></td>"))
    score = F.when(F.col("result").isNull(), F.lit("")).otherwise(
        F.concat(F.col("home_goals").cast("int").cast("string"), F.element_at(F.array(*map(F.lit, ("–", "&#8211;", "&#x2013;", "&ndash;"))), (F.dayofmonth("match_date") % 4 + 1).cast("int")), F.col("away_goals").cast("int").cast("string")))
    time = F.when(F.weekday("match_date").isin(5, 6), F.lit("17:00")).otherwise(F.lit("20:00"))
    row = F.concat(F.lit("<tr>"), td(F.date_format("match_date", "dd/MM/yyyy")), td(time), link(F.col("home_team")),
                   td(score), link(F.col("away_team")), td(F.lit("")), td(_esc(F.col("venue"))), F.lit("</tr>"))
    header = ("<tr>" + "".join(f"<th>{h}</th>" for h in ("Date", "Time", "Home", "Score", "Away", "Attendance", "Venue"))
              + "</tr>")
    rows = matches.select("league", "season_year",
                          F.struct("match_date", "home_team", "away_team").alias("k"), row.alias("r"))
    # rows go to their page one by one: collected where they lie, half-built pages would be shuffled
    pages = rows.repartition("league", "season_year").groupBy("league", "season_year").agg(F.sort_array(F.collect_list(F.struct("k", "r"))).alias("rs"))
    body = F.col("rs.r")
    body = F.array_insert(body, F.least(F.size(body) + 1, F.lit(11)), F.lit(header))
    body = F.concat(body, F.array(F.lit("<tr><td>01/01/2000</td><td>20:00</td></tr>")))
    html = F.concat(F.lit('<html><body><table data-id="sched_old"><tr><td>none</td></tr></table><div class="note">Fixtures</div><table id="sched_all" class="stats_table">'
                          "<thead>" + header + "</thead><tbody>"), F.array_join(body, "\n"),
                    F.lit("</tbody></table></body></html>"))
    return pages.select("league", "season_year",
                        F.concat(F.lit("/fixtures/"), F.col("league").cast("string"), F.lit("/"),
                                 F.col("season_year").cast("string")).alias("url"), html.alias("html"))


STAT_COLS = ["games", "wins", "draws", "losses", "goals_for", "goals_against", "points"]


def standings_pages(snapshot: DataFrame) -> DataFrame:
    """One standings page per (league, season) from a snapshot: a visible decoy
    table, then the standings table inside an HTML comment; the third row has a
    blank points cell; plus one page per league without any table."""
    def td(stat, val):
        return F.concat(F.lit(f'<td data-stat="{stat}">'), F.coalesce(val.cast("string"), F.lit("")), F.lit("</td>"))
    pts = F.when(F.col("ordinal") == 3, F.lit(None)).otherwise(F.col("points"))
    row = F.concat(F.lit("<tr>"), F.concat(F.lit('<th scope="row" data-stat="rank">'), F.col("ordinal").cast("string"),
                                           F.lit("</th>")),
                   F.concat(F.lit('<td data-stat="team"><a href="#">'), _esc(F.col("team")), F.lit("</a></td>")),
                   td("games", F.col("played")), td("wins", F.col("wins")), td("draws", F.col("draws")),
                   td("losses", F.col("losses")), td("goals_for", F.col("goals_for")),
                   td("goals_against", F.col("goals_against")), td("points", pts), F.lit("</tr>"))
    head = ("<thead><tr><th>Rk</th><th>Squad</th><th>MP</th><th>W</th><th>D</th><th>L</th><th>GF</th><th>GA</th>"
            "<th>Pts</th></tr></thead>")
    decoy = ('<table id="attendance"><thead><tr><th>Squad</th><th>Attendance</th></tr></thead>'
             "<tbody><tr><td>Nobody</td><td>0</td></tr></tbody></table>")
    rows = snapshot.select("league", "season", F.struct("ordinal", row.alias("r")).alias("x"))
    pages = rows.groupBy("league", "season").agg(F.array_sort(F.collect_list("x")).alias("rs"))
    html = F.concat(F.lit("<html><body>" + decoy + "\n<!--\n<table class=\"stats_table\">" + head + "<tbody>"),
                    F.array_join(F.transform("rs", lambda x: x.r), "\n"),
                    F.lit("</tbody></table>\n-->\n</body></html>"))
    tables = pages.select("league", "season", html.alias("html"))
    empty = snapshot.select("league").distinct().select(
        "league", F.lit("notice").alias("season"),
        F.lit("<html><body><!-- no table here --><p>Standings unavailable</p></body></html>").alias("html"))
    return tables.unionByName(empty)
