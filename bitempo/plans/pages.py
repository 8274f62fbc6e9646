"""Parsers of pages: tables of catches, listings, details, archives. The pages are made from the driver's tables, with what a parser must bear."""

from __future__ import annotations

from ..functions import scalars as S
from ..sources.adapters import plan
from .queries import query


def _first(d, x: str, r: str) -> str:
    return d.at(d.found(x, r), "0")


def _number(d, x: str) -> str:
    """A whole number with commas between thousands, of at most 15 digits."""
    bare = f"replace({x}, ',', '')"
    return d.int_or_null(f"CASE WHEN length({bare}) <= 15 THEN {bare} END")


#: Signs of a page that stands in for another.
CHALLENGE = "verify that you.?re not a robot|JavaScript is disabled|Enable JavaScript and then reload"


def _text(d, x: str) -> str:
    """The text of a fragment: no scripts, styles or tags, entities decoded, spaces collapsed."""
    bare = d.replace(d.replace(x, "<script[^>]*>[^<]*</script>|<style[^>]*>[^<]*</style>", " "), "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = f"replace({bare}, '{name}', '{sign}')"
    return f"trim({d.replace(bare, '[ \\t\\r\\n]+', ' ')})"


def _catch_pages(d) -> str:
    """A page for each order: how many came, and a row of name, size and count for each of its lines; rows before it are joined by a mark."""
    k = "l_orderkey * 7 + l_linenumber"
    name = f"CASE ({k}) % 6 WHEN 0 THEN 'アジ' WHEN 1 THEN 'サバ' WHEN 2 THEN 'シーバス' WHEN 3 THEN '' WHEN 4 THEN 'ハゼ&amp;ボラ' ELSE 'コノシロ' END"
    size = f"CASE ({k}) % 5 WHEN 0 THEN '12〜18cm' WHEN 1 THEN '20cm' WHEN 2 THEN '30〜10cm' WHEN 3 THEN '15' ELSE '12.cm' END"
    count = f"CASE ({k}) % 4 WHEN 0 THEN '合計 1,234 匹' WHEN 1 THEN concat('合計 ', {d.text(f'({k}) % 90')}, ' 匹') WHEN 2 THEN '多数' ELSE '合計0匹' END"
    row = f"""concat('<div class="x flex border-b border-gray-300"><div>', {name}, '</div><div><p>', {size}, '</p></div><div><p>', {count}, '</p></div></div>')"""
    body = d.listed(row, "l_linenumber")
    came = f"CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '<p>本日の入場者数は 1,205 名様</p>' WHEN 2 THEN concat('<p>本日の入園者数は', {d.text('l_orderkey % 300')}, '名</p>') WHEN 3 THEN '<p>12名、本日のご来場者数は ３０ 名</p>' ELSE '<p>明日の入場者数は9名</p>' END"
    return f"SELECT l_orderkey AS page, concat('<html>', {came}, replace({body}, '</div>,<div class', '</div><div class'), '</html>') AS html FROM lineitem GROUP BY l_orderkey"


CATCH_ROW = '<div class="[^"]*flex[^"]*border-b[^"]*border-gray-300[^"]*"><div>([^<]*)</div><div><p>([^<]*)</p></div><div><p>([^<]*)</p></div></div>'


@query
def parse_html_rows(d):
    """Each row of a page's table: name, sizes in cm (none where reversed or malformed) and count (null where none is told)."""
    rows = f"SELECT page, i, {d.at('whole', 'i')} AS r FROM (SELECT page, {d.found('html', CATCH_ROW, 0)} AS whole FROM ({_catch_pages(d)}) AS p) AS w {d.explode(d.between('0', f'{d.size("whole")} - 1'), 'i')} WHERE {d.size('whole')} > 0"
    parts = f"SELECT page, i, {_text(d, d.at(d.found('r', CATCH_ROW, 1), '0'))} AS name, {d.at(d.found('r', CATCH_ROW, 2), '0')} AS size, {d.at(d.found('r', CATCH_ROW, 3), '0')} AS said FROM ({rows}) AS x"
    numbers = f"SELECT *, {d.found('size', '([0-9]+)')} AS ns, {d.like('size', '[0-9][.][ ]*cm')} AS malformed, {d.like('size', 'cm')} AS in_cm FROM ({parts}) AS y WHERE name <> ''"
    sizes = f"SELECT page, i, name, {_number(d, _first(d, 'said', '合計 *([0-9,]+) *匹'))} AS count, CASE WHEN in_cm AND NOT malformed THEN {d.int_or_null(d.at('ns', '0'))} END AS low, CASE WHEN in_cm AND NOT malformed THEN coalesce({d.int_or_null(d.at('ns', '1'))}, {d.int_or_null(d.at('ns', '0'))}) END AS high FROM ({numbers}) AS z"
    return f"SELECT page, i, name, count, CASE WHEN low <= high THEN low END AS low, CASE WHEN low <= high THEN high END AS high FROM ({sizes}) AS s"


@query
def parse_visitor_count(d):
    """The number that the label names, full-width digits included; no other number of the page."""
    ascii_ = "translate(html, '０１２３４５６７８９', '0123456789')"
    return f"SELECT page, {_number(d, _first(d, 'html', '本日の(?:入場者数|入園者数|ご来場者数)は *([0-9,]+) *名'))} AS visitors FROM (SELECT page, {ascii_} AS html FROM ({_catch_pages(d)}) AS p) AS a"


@query
def discover_months(d):
    """The months that an archive's menu names, once each; others of its options are none."""
    label = "CASE o_orderkey % 7 WHEN 0 THEN 'all' WHEN 1 THEN '2024年 13月' ELSE concat(substring(m, 1, 4), '年', substring(m, 5, 2), '月') END"
    value = "CASE o_orderkey % 5 WHEN 0 THEN 'https://x.example/a' WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE m END"
    option = f"""concat('<option value="', {value}, '">', {label}, '</option>')"""
    pages = f"SELECT site, {d.listed(option, 'o_orderkey')} AS html FROM (SELECT o_custkey % 10 AS site, o_orderkey, {d.text(d.month(d.days('o_orderdate')))} AS m FROM orders) AS o GROUP BY site"
    each = f"SELECT site, {d.at('options', 'i')} AS o FROM (SELECT site, {d.found('html', '<option[^>]*>[^<]*</option>', 0)} AS options FROM ({pages}) AS p) AS x {d.explode(d.positions('options'), 'i')}"
    told = f"SELECT site, {_first(d, 'o', '>([0-9]{4})年')} AS y, {_first(d, 'o', '年 *([0-9]{1,2})月')} AS mo, {_first(d, 'o', 'value="([^"]*)"')} AS v FROM ({each}) AS e"
    good = f"{d.like('v', '^https?://|^[0-9]{6}$')} AND {d.int_or_null('mo')} BETWEEN 1 AND 12"
    return f"SELECT DISTINCT site, concat(y, '-', lpad(mo, 2, '0')) AS month FROM ({told}) AS t WHERE y IS NOT NULL AND {good}"


def _listing_pages(d) -> str:
    """A listing for each user: links to single trips under month headings; some pages have plain text or a challenge instead."""
    text = "concat(CASE event_id % 3 WHEN 0 THEN 'シーバス ' WHEN 1 THEN 'アジ &amp; ' ELSE '' END, " + d.text("event_id % 6") + ", '匹')"
    link = f"""concat('<a class="l" href="/fishings/', {d.text('event_id')}, '">', {text}, '</a>')"""
    plain = f"concat('<p>trip ', {d.text('event_id')}, ' ', {text}, '</p>')"
    return f"SELECT user_id, concat('<h2>', {d.text('2020 + user_id % 5')}, '年', {d.text('1 + user_id % 12')}, '月</h2>', CASE WHEN user_id % 11 = 0 THEN 'JavaScript is disabled' WHEN user_id % 7 = 0 THEN {d.listed(plain, 'event_id')} ELSE {d.listed(link, 'event_id')} END) AS html FROM events GROUP BY user_id"


@query
def parse_listing_page(d):
    """The records of a listing, from its links or, where it has none, from its plain text; one row without a record for a challenge."""
    challenge = d.like("html", CHALLENGE)
    pages = f"SELECT user_id, html, {challenge} AS challenged, {_first(d, 'html', '([0-9]{4}年[0-9]{1,2}月)')} AS heading, CASE WHEN {challenge} THEN {d.found('html', 'no such text', 0)} WHEN {d.like('html', '/fishings/[0-9]')} THEN {d.found('html', '<a[^>]*href="/fishings/[0-9]+"[^>]*>[^<]*</a>', 0)} ELSE {d.found('html', '<p>trip [0-9]+ [^<]*</p>', 0)} END AS records FROM ({_listing_pages(d)}) AS l"
    each = f"SELECT user_id, heading, {d.at('records', 'i')} AS r FROM ({pages}) AS p {d.explode(d.between('0', f'{d.size("records")} - 1'), 'i')} WHERE {d.size('records')} > 0"
    found = f"SELECT user_id, 'PARSED' AS status, heading, coalesce({_first(d, 'r', '/fishings/([0-9]+)')}, {_first(d, 'r', 'trip ([0-9]+)')}) AS record, {d.like('r', 'シーバス')} AS seabass, {_number(d, _first(d, 'r', '([0-9]+)匹'))} AS count FROM ({each}) AS e"
    none = f"SELECT user_id, CASE WHEN challenged THEN 'JS_CHALLENGE' ELSE 'PARSED' END AS status, CASE WHEN NOT challenged THEN heading END AS heading, NULL AS record, NULL AS seabass, NULL AS count FROM ({pages}) AS p WHERE {d.size('records')} = 0"
    return f"{found} UNION ALL {none}"


@query
def parse_area_page(d):
    """An area's page: its counters by their labels, months and pages that it names; of a challenge only that it is one."""
    n = "s_suppkey"
    body = f"concat('<title>area ', s_name, '</title>釣果投稿 ', {d.text(f'{n} * 1234')}, '件 魚の種類 ', {d.text(f'{n} % 40')}, ' 釣り場 ', {d.text(f'{n} % 9')}, CASE WHEN {n} % 3 = 0 THEN ' 最新投稿は2024年05月06日' ELSE '' END, '<h3>2024年5月</h3><h3>2023年12月</h3>', CASE WHEN {n} % 2 = 0 THEN '<a href=\"?page=2\">2</a><a href=\"?page=3\">3</a>' ELSE '' END, CASE WHEN {n} % 4 = 0 THEN '最近の釣り人' ELSE '' END, CASE WHEN {n} % 5 = 0 THEN 'Enable JavaScript and then reload' ELSE '' END)"
    challenge = d.like("html", CHALLENGE)
    shown = lambda x: f"CASE WHEN NOT {challenge} THEN {x} END"
    label = lambda w: shown(_number(d, _first(d, "html", f"{w} *([0-9,]+)")))
    months = d.found("html", "([0-9]{4}年[0-9]{1,2}月)<")
    oldest = d.at(months, f"{d.size(months)} - 1")
    depth = S.month_distance(d.int_or_null(f"substring({oldest}, 1, 4)"), d.int_or_null(f"replace(substring({oldest}, 6, 2), '月', '')"), "2024", "8")
    return f"SELECT s_suppkey, CASE WHEN {challenge} THEN 'JS_CHALLENGE' ELSE 'PARSED' END AS status, {shown(_first(d, 'html', '<title>([^<]*)</title>'))} AS display_name, {label('釣果投稿')} AS total_posts, {label('魚の種類')} AS species, {label('釣り場')} AS children, {shown(_first(d, 'html', '最新投稿は([0-9]{4}年[0-9]{2}月[0-9]{2}日)'))} AS latest, {shown(d.join(months, ','))} AS months, {shown(depth)} AS depth_months, {shown(d.join(d.found('html', '[?]page=([0-9]+)'), ','))} AS pages, {shown(d.like('html', '最近の釣り人|さんの釣行'))} AS reporters_visible FROM (SELECT s_suppkey, {body} AS html FROM supplier) AS p"


@query
def parse_detail_page(d):
    """One trip's page: the times it shows, as UTC minutes, its fish, sizes and count; of a challenge only that it is one."""
    k = "o_orderkey"
    time = f"concat('日時 ', {d.text(f'2020 + {k} % 5')}, '年', lpad({d.text(f'1 + {k} % 13')}, 2, '0'), '月', lpad({d.text(f'1 + {k} % 31')}, 2, '0'), '日(土) ', lpad({d.text(f'{k} % 24')}, 2, '0'), ':30〜', lpad({d.text(f'{k} % 24')}, 2, '0'), ':45')"
    body = f"concat(CASE WHEN {k} % 4 > 0 THEN {time} ELSE '' END, '<b>釣った魚</b> ', CASE {k} % 3 WHEN 0 THEN concat('シーバス ', {d.text(f'{k} % 90')}, '.5cm フッコ 40cm') WHEN 1 THEN 'アジ 20cm' ELSE '' END, ' <b>天気</b> 晴れ セイゴ 22cm 投稿 ', {d.text(f'{k} % 7')}, '件', CASE WHEN {k} % 17 = 0 THEN 'Enable JavaScript and then reload' ELSE '' END)"
    challenge = d.like("html", CHALLENGE)
    shown = lambda x: f"CASE WHEN NOT {challenge} THEN {x} END"
    part = lambda r: _first(d, "body", r)
    year = part("日時 *([0-9]{4})年")
    day = f"concat({year}, '-', {part('日時 *[0-9]{4}年([0-9]{2})月')}, '-', {part('日時 *[0-9]{4}年[0-9]{2}月([0-9]{2})日')})"
    start, end = f"concat({day}, ' ', {part('[)] *([0-9]{2}:[0-9]{2})〜')})", f"concat({day}, ' ', {part('〜([0-9]{2}:[0-9]{2})')})"
    block = part("釣った魚(.*)天気")
    species = f"CASE WHEN {d.like(block, 'シーバス|スズキ|フッコ|セイゴ')} THEN 'seabass' END"
    count = _number(d, part("投稿 *([0-9]+)件"))
    return f"SELECT {k}, CASE WHEN {challenge} THEN 'JS_CHALLENGE' ELSE 'PARSED' END AS status, {shown(f'CASE WHEN {year} IS NOT NULL THEN {day} END')} AS event_date, {shown(S.jst_minute(d, start))} AS start_minute, {shown(S.jst_minute(d, end))} AS end_minute, {shown(count)} AS posts, {shown(species)} AS species, {shown(f'CASE WHEN {species} IS NOT NULL THEN {count} END')} AS catch_count, coalesce({shown(f'{species} IS NOT NULL')}, false) AS positive, {shown(d.join(d.found('body', '(?:シーバス|スズキ|フッコ|セイゴ) +([0-9]+(?:[.][0-9]+)?)cm'), ','))} AS sizes FROM (SELECT {k}, html, {_text(d, 'html')} AS body FROM (SELECT {k}, {body} AS html FROM orders) AS p) AS t"


@query
def unpivot_indexed_columns(d):
    """Wide columns by number to a row each, blank ones dropped: one scan, whatever the number of columns."""
    wide = ", ".join(f"CASE WHEN (p_partkey + {i}) % 4 > 0 THEN concat(p_brand, '-', '{i}') WHEN (p_partkey + {i}) % 8 = 0 THEN ' ' END AS fish{i}" for i in range(1, 31))
    names = " ".join(f"WHEN {i} THEN fish{i}" for i in range(1, 31))
    return f"SELECT p_partkey, k + 1 AS i, trim(CASE k + 1 {names} END) AS name FROM (SELECT p_partkey, {wide} FROM part) AS w {d.explode(d.upto(30), 'k')} WHERE trim(CASE k + 1 {names} END) <> ''"


@query
def url_normalize(d):
    """https and the known host alone, without its fragment, and then one of the allowed."""
    url = "CASE page_id % 6 WHEN 0 THEN replace(url, 'https:', 'http:') WHEN 1 THEN concat(url, '#part') WHEN 2 THEN concat('https://other.example/', page_id) ELSE url END"
    bare = d.replace("u", "#.*$", "")
    allowed = f"SELECT DISTINCT {d.replace('url', '#.*$', '')} AS u FROM pages WHERE page_id % 5 > 0"
    return f"SELECT p.page_id, CASE WHEN NOT {d.like('p.u', '^https://')} THEN 'not-https' WHEN a.u IS NULL THEN 'not-allowed' ELSE 'allowed' END AS verdict, CASE WHEN {d.like('p.u', '^https://')} THEN a.u END AS url FROM (SELECT page_id, {url} AS u FROM pages) AS p LEFT JOIN ({allowed}) AS a ON a.u = {bare.replace('u', 'p.u', 1)}"


@query
def published_value(d):
    """A published cell: blank, a dash or a word of suspension is missing; else a number, commas removed, or its text."""
    said = "CASE p_partkey % 12 WHEN 0 THEN '' WHEN 1 THEN ' - ' WHEN 2 THEN '--' WHEN 3 THEN '×' WHEN 4 THEN '−' WHEN 5 THEN '観測休止中' WHEN 6 THEN '欠測' WHEN 7 THEN '1,234' WHEN 8 THEN ' 12 ' WHEN 9 THEN '-7' WHEN 10 THEN 'high' END"
    missing = f"(trim(said) = '' OR {d.like('trim(said)', '^(--?|×|−)$')} OR {d.like('said', S.SUSPENDED)})"
    number = d.int_or_null("replace(trim(said), ',', '')")
    return f"SELECT p_partkey, CASE WHEN said IS NULL THEN 'not-provided' WHEN {missing} THEN 'source-missing' END AS reason, CASE WHEN NOT {missing} THEN {number} END AS value, CASE WHEN NOT {missing} AND {number} IS NULL THEN trim(said) END AS text FROM (SELECT p_partkey, {said} AS said FROM part) AS s"


@query
def fixed_width_to_obs(d):
    """Daily lines to hours: a line that comes twice counts once, two different lines of a day are a conflict, a station that is not registered an error."""
    from .queries import _level, _lines

    kept = f"SELECT substring(line, 73, 8) AS k, min(line) AS line, count(*) - 1 AS repeats, count(DISTINCT line) AS texts FROM ({_lines(d)}) AS l GROUP BY substring(line, 73, 8)"
    told = f"SELECT k, line, repeats, CASE WHEN substring(k, 7, 2) NOT IN ('S0', 'S1', 'S2') THEN 'unknown-station' WHEN texts > 1 THEN 'conflict' WHEN repeats > 0 THEN 'duplicate-ignored' ELSE 'read' END AS outcome FROM ({kept}) AS x"
    hours = f"SELECT substring(k, 7, 2) AS station, substring(k, 1, 6) AS ymd, hour, {_level(d, 'hour')} AS level, outcome FROM ({told}) AS t {d.explode(d.upto(24), 'hour')} WHERE outcome IN ('read', 'duplicate-ignored')"
    return plan(d, "reports", f"{hours} UNION ALL SELECT substring(k, 7, 2), substring(k, 1, 6), NULL, NULL, outcome FROM ({told}) AS u WHERE outcome NOT IN ('read', 'duplicate-ignored')")


# -- one trip's section of a listing, to its record


def _sections(d) -> str:
    """A section for each order: a heading with date, daypart and target, an image that names the record, and a body of what was seen."""
    k = "o_orderkey"
    n = lambda x: d.text(x)
    some = lambda when, x: f"CASE WHEN {when} THEN {x} ELSE '' END"
    m = d.text(d.month(d.days("o_orderdate")))
    heading = f"concat('<h2>', {n(f'CASE WHEN {k} % 97 = 0 THEN 0 ELSE 20 END + CAST(substring({m}, 1, 4) AS INT)')}, '年', {n(f'CAST(substring({m}, 5, 2) AS INT)')}, '月', {n(f'1 + {k} % 31')}, '日(土) ', CASE {k} % 3 WHEN 0 THEN '午前便' WHEN 1 THEN 'ナイト便' ELSE '' END, CASE {k} % 4 WHEN 0 THEN ' シーバス' WHEN 1 THEN ' シーバスゲーム' WHEN 2 THEN ' アジ' ELSE ' 青物' END, '</h2>')"
    image = f"concat({some(f'{k} % 7 > 0', f'''concat('<img src="/images/1_', {n(k)}, '_a.jpg">')''')}, {some(f'{k} % 13 = 0', f'''concat('<img src="/images/2_', {n(f'{k} + 1')}, '_b.jpg">')''')})"
    body = "concat(" + ", ".join([
        "'<p>'", some(f"{k} % 17 = 0", "'強風のため出船中止。'"), some(f"{k} % 5 = 0", f"concat('シーバス', {n(f'{k} % 12')}, '本キャッチ。')"), some(f"{k} % 5 = 1", f"concat('シーバス', {n(f'{k} % 9')}, '本以上ゲット。')"), some(f"{k} % 6 = 1", f"concat({n(f'{k} % 20')}, 'ヒット。')"), some(f"{k} % 6 = 2", f"concat({n(f'{k} % 20')}, 'ヒット以上。')"),
        some(f"{k} % 8 = 3", "'バイト多数。'"), some(f"{k} % 9 = 4", "'チェイスあり。'"), some(f"{k} % 10 = 5", "'ルアーに付いてくる魚も。'"), some(f"{k} % 11 = 6", "'フックアウト。'"), some(f"{k} % 12 = 7", "'ボイル発生。'"), some(f"{k} % 14 = 8", "'シーバスは反応なし。'"), some(f"{k} % 3 > 0", f"concat({n(f'2 + {k} % 6')}, '時間便。')"), some(f"{k} % 4 > 0", f"concat({n(f'1 + {k} % 8')}, '名様。')"),
        some(f"{k} % 15 = 1", "'橋脚の明暗と'"), some(f"{k} % 16 = 2", "'ストラクチャー周り。'"), some(f"{k} % 18 = 3", "'濁りが入り、'"), some(f"{k} % 19 = 4", "'潮が動き出すと活性が変わった。'"), some(f"{k} % 21 = 5", "'ベイトは豊富。'"), some(f"{k} % 22 = 6", "'荒川河口で。'"), "'</p>'",
    ]) + ")"
    return f"SELECT {k} AS trip, concat({heading}, {image}, {body}) AS html FROM orders"


@query
def parse_trip_record(d):
    """A section as the record of its trip: when, whether it went and for what, what was landed, touched or seen, with which effort, where, and what of it is lost in evidence."""
    like, first = d.like, lambda x, r: _first(d, x, r)
    number = lambda x, r: d.int_or_null(first(x, r))
    ids = d.distinct(d.found("html", "/images/[0-9]+_([0-9]+)_"))
    base = f"SELECT trip, {d.size(ids)} AS n_ids, {d.at(ids, '0')} AS one_id, {first('html', '<h2>([^<]*)</h2>')} AS heading, coalesce({first('html', '<p>([^<]*)</p>')}, '') AS body FROM ({_sections(d)}) AS s"
    y, mo, day = (number("heading", r) for r in ("(20[0-9]{2})年", "年([0-9]{1,2})月", "月([0-9]{1,2})日"))
    dated = f"SELECT *, {y} AS y, {mo} AS mo, {day} AS dd, CASE WHEN {like('heading', 'ナイト')} THEN 'night' WHEN {like('heading', '午前')} THEN 'morning' ELSE 'unknown' END AS daypart, CASE WHEN {like('body', '中止|欠航')} THEN 'cancelled' ELSE 'completed' END AS status, {like('concat(heading, body)', 'シーバス')} AS mentioned, {like('heading', 'シーバス')} AS in_heading FROM ({base}) AS b"
    read = f"""SELECT *, CASE WHEN mentioned THEN in_heading END AS targeted, {number('body', 'シーバス([0-9]+)本キャッチ')} AS landed, {number('body', 'シーバス([0-9]+)本以上')} AS landed_least, {number('body', '([0-9]+)ヒット。')} AS hits, {number('body', '([0-9]+)ヒット以上')} AS hits_least, {like('body', 'バイト|アタリ')} AS bite, {like('body', 'チェイス|追尾')} AS chase, {like('body', '追って|付いてくる')} AS follow, {like('body', 'バラシ|フックアウト|ラインブレイク')} AS lost, {like('body', 'ボイル|群れ|姿が見え')} AS visible,
      {like('body', '反応なし|ノーバイト|釣れず|ノーフィッシュ')} AS zero_said, {number('body', '([0-9]+)時間')} * 60 AS minutes, {number('body', '([0-9]+)名様')} AS anglers, concat_ws(',', CASE WHEN {like('body', '橋脚')} THEN 'bridge' END, CASE WHEN {like('body', '明暗')} THEN 'light-edge' END, CASE WHEN {like('body', 'ストラクチャー')} THEN 'structure' END) AS habitat_clues,
      concat_ws(',', CASE WHEN {like('body', '濁り')} THEN 'turbidity' END, CASE WHEN {like('body', '潮')} THEN 'tide' END, CASE WHEN {like('body', '風')} THEN 'wind' END, CASE WHEN {like('body', 'ベイト')} THEN 'bait' END) AS environmental_clues, {like('body', '変わった|動き出')} AS change_mentioned, {first('body', '([^。、]*河口)で')} AS location FROM ({dated}) AS d"""
    real = f"y IS NOT NULL AND mo BETWEEN 1 AND 12 AND dd BETWEEN 1 AND {S.days_in_month('y', 'mo')}"
    judged = f"SELECT *, coalesce({real}, false) AS real_day, coalesce(landed, landed_least, 0) > 0 AS landed_positive, bite OR lost OR coalesce(hits, hits_least, 0) > 0 AS contact, status = 'completed' AND coalesce(targeted, false) AS effort, status = 'completed' AND coalesce(targeted, false) AND zero_said AS zero_segment FROM ({read}) AS r"
    zero = "(zero_segment AND NOT landed_positive AND NOT contact)"
    fields = "concat_ws(',', CASE WHEN landed IS NULL AND landed_least > 0 THEN 'landed-lower-bound' END, CASE WHEN hits IS NULL AND hits_least > 0 THEN 'contact-lower-bound' END, CASE WHEN follow THEN 'follow' END, CASE WHEN visible THEN 'visible-fish' END, CASE WHEN change_mentioned THEN 'condition-change' END)"
    last = f"SELECT *, {zero} AS zero_candidate, {fields} AS lost_fields, status = 'completed' AND (landed_positive OR contact OR {zero} AND (minutes IS NOT NULL OR anglers IS NOT NULL)) AS convertible FROM ({judged}) AS j"
    date = f"concat({d.text('y')}, '-', lpad({d.text('mo')}, 2, '0'), '-', lpad({d.text('dd')}, 2, '0'))"
    problems = "concat_ws(',', CASE WHEN n_ids = 0 THEN 'numeric-detail-id-missing' WHEN n_ids > 1 THEN 'numeric-detail-id-ambiguous' END, CASE WHEN daypart = 'unknown' THEN 'daypart-missing' ELSE 'daypart-only-no-clock' END, CASE WHEN zero_segment AND NOT zero_candidate THEN 'segment-zero-not-trip-zero' END, CASE WHEN status = 'cancelled' THEN 'cancelled-not-zero' END, CASE WHEN lost_fields <> '' THEN 'foundation-information-loss' END)"
    known = lambda c: f"{c} IS NOT NULL AS {c}_known, {c}"
    return f"""SELECT trip, CASE WHEN n_ids = 1 THEN concat('post:', one_id) END AS record_id, CASE WHEN real_day THEN {date} END AS event_date, CASE WHEN real_day THEN concat({date}, '-', daypart, '-', CASE WHEN targeted THEN 'seabass' ELSE 'other' END) END AS event_key, CASE WHEN real_day THEN 'ok' ELSE 'record-date-invalid' END AS parse_status, status AS trip_status, daypart, CASE WHEN daypart = 'unknown' THEN 'date-only' ELSE 'daypart' END AS temporal_precision, false AS exact_clock_known, mentioned, targeted,
      {known('landed')}, landed_least, landed_positive, contact AS contact_present, {known('hits')}, hits_least, bite, chase, follow, lost, visible, effort AS explicit_effort, zero_candidate, zero_segment, {known('minutes')}, CASE WHEN minutes IS NOT NULL THEN 'body' END AS minutes_source, {known('anglers')}, habitat_clues, environmental_clues, change_mentioned, change_mentioned AND landed_positive AS before_after_resolvable, {known('location')}, convertible, CASE WHEN NOT convertible THEN 'not-convertible' WHEN lost_fields = '' THEN 'convertible-without-loss' ELSE 'convertible-with-information-loss' END AS convertibility, lost_fields, {problems} AS diagnostics FROM ({last}) AS l"""
