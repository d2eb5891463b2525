"""The registered queries as SQL over the driver's raw tables.

Each text is assembled from the named steps it mentions. They restate the rules
independently of the Spark code and only share its fixed values.
"""

from __future__ import annotations

import re

from platewise import adapters
from platewise.functions import lexicons, text
from platewise.operators import menu, names, timeseries
from platewise.plans import queries as q

MONEY = "decimal(18,2)"


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(words) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _any_plural(words) -> str:
    return r"\b(" + "|".join(words) + r")(s|es)?\b"


_SPREAD = "CAST('0x' || substr(md5(CAST(review_id AS varchar)), 1, 8) AS bigint)"


def _replace(column: str, pattern: str, by: str) -> str:
    return f"regexp_replace({column}, '{pattern}', '{by}', 'g')"


def _chain(column: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        column = _replace(column, pattern, by)
    return column


def _squeeze(column: str) -> str:
    return "trim(" + _replace(column, r"\s+", " ") + ")"


def _title(column: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({column}, ' '), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
    )


def _case_map(table: dict[str, str], value: str) -> str:
    return "CASE " + value + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {value} END"


def _spell(column: str, table: dict[str, str]) -> str:
    return f"array_to_string(list_transform(string_split({column}, ' '), lambda w: {_case_map(table, 'w')}), ' ')"


def _mentions(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _matches(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::int" for w in words) + ")"


def _normal(column: str) -> str:
    return _squeeze(_chain(f"lower({column})", (text.ADDON, ""), (text.MILLILITRES, ""), (text.NOT_ALPHANUMERIC, " ")))


NOISE = _any(lexicons.NOISE_WORDS)
PRICES = ((text.PRICE_BEFORE, r" @\2 "), (text.PRICE_AFTER, r" @\1\4 "))


def _stripped(column: str) -> str:
    steps = (*PRICES, (text.PRICE_MARK, " "), (text.QUANTITY, " "), (text.ADD_ON, " "), (NOISE, " "))
    return _squeeze(_chain(f"lower({column})", *steps))


def _segments(column: str) -> str:
    steps = (*PRICES, (text.HARD_SEPARATOR, "|"), (r"\s-\s", " "), (text.QUANTITY, r"\1_\2"), (text.INNER_QUANTITY, r"\1|\2 \4"))
    return f"string_split({_chain(f'lower({column})', *steps)}, '|')"


def _component(segment: str) -> str:
    steps = (
        (text.PRICE_MARK, " "), (text.JOINED_QUANTITY, " "), (r"\b\d+\b", " "), (text.ADD_ON, " "), (NOISE, " "),
        (r"[^a-z0-9'' ]", " "), (r"^\s*of\b", " "),
    )
    return _spell(_squeeze(_chain(segment, *steps)), lexicons.SPELLINGS)


def _details(name: str) -> str:
    part = (
        f"CASE WHEN {_component('s')} <> '' THEN {_title(_component('s'))} "
        f"|| CASE WHEN regexp_extract(s, '{text.JOINED_QUANTITY}', 1) <> '' THEN ' (' || regexp_extract(s, '{text.JOINED_QUANTITY}', 1) || ' ' || "
        f"{_case_map(lexicons.UNITS, f'regexp_extract(s, {chr(39)}{text.JOINED_QUANTITY}{chr(39)}, 2)')} || ')' ELSE '' END "
        f"|| CASE WHEN regexp_extract(s, '{text.PRICE_MARK}', 1) <> '' THEN ' [' || regexp_extract(s, '{text.PRICE_MARK}', 1) || ' Rs]' ELSE '' END END"
    )
    return f"array_to_string(list_filter(list_transform({_segments(name)}, lambda s: {part}), lambda d: d IS NOT NULL), ' | ')"


def _day_name(n: str) -> str:
    names = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(names)) + " END"


def _forecast(history: str, cut: str, horizon: int, window: int, series: str, scheduled: bool = True) -> str:
    """Weekday-mean forecast of a (series…, created_date, order_count) relation."""
    means = ", ".join(
        f"avg(order_count) FILTER (WHERE isodow(created_date) = {k}) AS m{k}" for k in range(1, 8)
    )
    served = (
        "CASE WHEN w.served IS NULL OR list_contains(w.served, isodow(f.date)) THEN 1 ELSE 0 END" if scheduled else "1"
    )
    join = "LEFT JOIN week w ON w.vendor_id = f.vendor_id" if scheduled else ""
    mean = "CASE isodow(f.date) " + " ".join(f"WHEN {k} THEN m{k}" for k in range(1, 8)) + " END"
    columns = ", ".join(f"f.{c}" for c in series.split(", "))
    return f"""
      SELECT {columns}, f.date,
        CAST(round(base * (1 - (1 - r) * weightage / 10) * served) AS bigint) AS order_count,
        'base ' || CAST(CAST(round(base, 2) AS decimal(18,2)) AS varchar) || ', holiday factor '
          || CAST(CAST(round(1 - (1 - r) * weightage / 10, 2) AS decimal(18,2)) AS varchar)
          || ', schedule factor ' || CAST(served AS varchar) AS reasoning
      FROM (
        SELECT f.*, coalesce({mean}, overall) AS base, coalesce(h.weightage, 0) AS weightage, {served} AS served
        FROM (
          SELECT s.*, CAST({cut} + CAST(n AS integer) AS date) AS date,
            coalesce(greatest(0.0, least(1.0, CASE WHEN weekdays > 0 THEN weekend / weekdays END)), 0.0) AS r
          FROM (
            SELECT {series}, avg(order_count) AS overall, {means},
              avg(order_count) FILTER (WHERE isodow(created_date) >= 6) AS weekend,
              avg(order_count) FILTER (WHERE isodow(created_date) < 6) AS weekdays
            FROM {history} WHERE created_date > {cut} - {window} AND created_date <= {cut}
            GROUP BY {series}
          ) s, range(1, {horizon} + 1) t(n)
        ) f
        LEFT JOIN (SELECT date, max(weightage) AS weightage FROM holidays GROUP BY date) h ON h.date = f.date
        {join}
      ) f"""


AS_OF = "(SELECT as_of FROM p)"
HOLIDAY_ROWS = ", ".join(
    f"({offset}, '{name.replace(chr(39), chr(39) * 2)}', '{region}', {weight})"
    for offset, (_, name, region, weight) in zip(adapters.HOLIDAY_OFFSETS, timeseries.HOLIDAYS)
)
QUESTION = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in adapters.QUESTIONS.items())

STEPS = {
    "p": "SELECT max(CAST(o_orderdate AS date)) AS as_of FROM orders",
    "headers": """
      SELECT o_orderkey AS id, o_custkey AS employee_id, o_orderstatus AS status, CAST(o_orderdate AS date) AS created_date
      FROM orders""",
    "items": """
      SELECT l_orderkey AS order_id, l_suppkey AS vendor_id, l_partkey AS product_id,
        CAST(l_quantity AS bigint) AS qty, l_extendedprice AS price FROM lineitem""",
    "sales": """
      SELECT DISTINCT h.id, h.employee_id, h.status, h.created_date, i.vendor_id
      FROM headers h JOIN items i ON i.order_id = h.id""",
    "listed_menu": """
      SELECT v.vendor_id, p_partkey AS id, p_name AS name, p_retailprice AS price, CAST(p_size <= 45 AS int) AS active,
        p_type, p_brand, p_size
      FROM (SELECT DISTINCT l_suppkey AS vendor_id, l_partkey FROM lineitem) v JOIN part ON p_partkey = v.l_partkey""",
    "recipes": """
      SELECT vendor_id, name AS menu_name, arg_max(p_type, id) AS kind, arg_max(p_brand, id) AS brand, arg_max(p_size, id) AS size
      FROM listed_menu WHERE p_type <> 'PROMO' GROUP BY vendor_id, name""",
    "recipe_lines": """
      SELECT vendor_id, menu_name, 0 AS position, kind AS ingredient, 'g' AS measurement_unit, CAST(size AS double) AS measurement_value FROM recipes
      UNION ALL
      SELECT vendor_id, menu_name, 1, brand, CASE WHEN size > 25 THEN 'ml' ELSE 'g' END, CAST(size * 10 AS double) FROM recipes""",
    "holidays": f"""
      SELECT CAST({AS_OF} + CAST(d AS integer) AS date) AS date, holiday, region, weightage
      FROM (VALUES {HOLIDAY_ROWS}) t(d, holiday, region, weightage)""",
    "shifts": """
      SELECT l_suppkey AS vendor_id, CAST(s_nationkey AS bigint) AS location_id, dayofweek(l_shipdate) AS dow,
        printf('%02d:00', min(l_linenumber) + 6) AS start_time, printf('%02d:00', max(l_linenumber) + 12) AS end_time,
        CAST(count(*) FILTER (WHERE l_returnflag = 'R') * 3 <= count(*) AS int) AS active
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, s_nationkey, dayofweek(l_shipdate), l_linestatus""",
    "week": "SELECT vendor_id, list(DISTINCT (dow + 6) % 7 + 1) AS served FROM shifts WHERE active = 1 GROUP BY vendor_id",
    "daily_all": "SELECT vendor_id, created_date, count(*) AS order_count FROM sales GROUP BY ALL",
    "daily": f"SELECT * FROM daily_all WHERE created_date > {AS_OF} - 60",
    "sold": f"""
      SELECT i.vendor_id, h.created_date, i.product_id, i.qty, i.price, h.status, p_name AS name, p_retailprice AS menu_price
      FROM headers h JOIN items i ON i.order_id = h.id JOIN part ON p_partkey = i.product_id
      WHERE h.created_date > {AS_OF} - 90""",
    "product_days": """
      SELECT vendor_id, created_date, product_id, max(name) AS product_name, count(*) AS order_count
      FROM sold GROUP BY vendor_id, created_date, product_id""",
    "item_days": """
      SELECT vendor_id, created_date, product_id, max(name) AS menu_name, count(qty) AS order_count, max(price) AS item_price
      FROM sold GROUP BY vendor_id, created_date, product_id""",
    "revenue": f"""
      SELECT vendor_id, created_date, CAST(sum(CAST(menu_price AS {MONEY})) AS double) AS daily_sales, count(*) AS total_orders
      FROM sold WHERE status NOT IN ({_list(q.EXCLUDED)}) GROUP BY vendor_id, created_date""",
    "months": f"""
      SELECT vendor_id, strftime(created_date, '%Y-%m') AS month, CAST(sum(CAST(daily_sales AS {MONEY})) AS double) AS sales,
        CAST(sum(total_orders) AS bigint) AS orders FROM revenue GROUP BY ALL""",
    "totals": f"""
      SELECT vendor_id, CAST(sum(CAST(daily_sales AS {MONEY})) AS double) AS sales, CAST(sum(total_orders) AS bigint) AS orders
      FROM revenue GROUP BY vendor_id""",
    "item_totals": """
      SELECT vendor_id, menu_name, CAST(sum(order_count) AS bigint) AS orders,
        first(item_price ORDER BY created_date, product_id) AS price, min(created_date) AS first_date,
        first(product_id ORDER BY created_date, product_id) AS first_product_id
      FROM item_days GROUP BY vendor_id, menu_name""",
    "next_day": """
      SELECT vendor_id, product_id, product_name, last_n AS last_day_order_count, coalesce(previous_n, last_n) AS previous_day_order_count,
        CAST(round((last_n + coalesce(previous_n, last_n)) / 2) AS bigint) AS this_day_prediction
      FROM (SELECT vendor_id, product_id, product_name, created_date, order_count AS last_n,
          lag(order_count) OVER (PARTITION BY vendor_id, product_id ORDER BY created_date) AS previous_n,
          max(created_date) OVER (PARTITION BY vendor_id, product_id) AS last_date
        FROM product_days) WHERE created_date = last_date""",
    "document_reviews": f"""
      SELECT doc_id AS id, doc_id % (SELECT count(*) FROM supplier) AS vendor_id, CAST(1 + doc_id % 5 AS int) AS rating,
        CASE WHEN lang = 'de' THEN 'vendor' ELSE 'order' END AS reference,
        CAST({AS_OF} - CAST(doc_id % 120 AS integer) AS date) AS order_created_date, p_name AS order_items
      FROM documents JOIN part ON p_partkey = doc_id % (SELECT count(*) FROM part)""",
    "order_reviews": f"""
      SELECT * FROM document_reviews WHERE reference = 'order' AND order_created_date > {AS_OF} - 90""",
    "answers": f"""
      SELECT doc_id * 100000 + i - 1 AS response_id, doc_id AS review_id,
        doc_id * 3 + greatest(0, i - len(lines)) AS review_option_id,
        CASE WHEN i <= len(lines) THEN 'text' WHEN i = len(lines) + 1 THEN 'checkbox' ELSE 'star' END AS type,
        CASE WHEN i <= len(lines) THEN lines[i]
          WHEN i = len(lines) + 1 THEN CASE WHEN n_chars % 2 = 0 THEN CASE lang {QUESTION} ELSE '{adapters.QUESTION_ELSE}' END ELSE '' END
          WHEN n_chars % 3 <> 0 THEN 'star:' || CAST(n_chars % 6 AS varchar) ELSE '' END AS segment
      FROM (SELECT *, unnest(range(1, len(lines) + 3)) AS i
        FROM (SELECT doc_id, lang, n_chars, string_split(text, chr(10)) AS lines FROM documents))""",
    "comments": """
      SELECT r.id AS review_id, r.vendor_id, r.order_items, r.rating AS stars, CAST(r.rating AS varchar) || '/5' AS rating,
        CAST(r.order_created_date + 1 AS date) AS comment_date, string_agg(a.segment, '. ' ORDER BY a.response_id) AS user_comment
      FROM order_reviews r JOIN answers a ON a.review_id = r.id GROUP BY ALL""",
    "ratios": """
      SELECT vendor_id, order_items, count(*) AS reviews,
        round(count(*) FILTER (WHERE stars >= 3) * 100 / count(*), 2) AS positive_neutral_percentage,
        round(count(*) FILTER (WHERE stars <= 2) * 100 / count(*), 2) AS negative_percentage
      FROM comments GROUP BY vendor_id, order_items""",
    "ratings": """
      SELECT t.vendor_id, t.menu_name, t.orders, t.price, c.rating, coalesce(c.reviews, 0) AS reviews
      FROM item_totals t LEFT JOIN (
        SELECT vendor_id, order_items, round(avg(stars), 4) AS rating, count(*) AS reviews FROM comments GROUP BY ALL
      ) c ON c.vendor_id = t.vendor_id AND c.order_items = t.menu_name""",
    "performance": """
      SELECT vendor_id, position, menu_name, orders, price, rating FROM (
        SELECT t.*, r.rating,
          row_number() OVER (PARTITION BY t.vendor_id ORDER BY t.orders DESC, first_date, first_product_id) AS up,
          row_number() OVER (PARTITION BY t.vendor_id ORDER BY t.orders, first_date DESC, first_product_id DESC) AS down
        FROM item_totals t JOIN ratings r ON r.vendor_id = t.vendor_id AND r.menu_name = t.menu_name
      ), (VALUES ('best'), ('worst')) v(position)
      WHERE (position = 'best' AND up = 1) OR (position = 'worst' AND down = 1)""",
    "item_forecast": _forecast("product_days", AS_OF, 7, 90, "vendor_id, product_id, product_name"),
    "forecast_lines": """
      SELECT f.vendor_id, f.product_name, f.order_count, f.first_date, f.first_product, l.position, l.ingredient, l.measurement_unit, l.measurement_value
      FROM (SELECT vendor_id, product_name, CAST(sum(order_count) AS bigint) AS order_count, min(date) AS first_date, min(product_id) AS first_product
        FROM item_forecast GROUP BY ALL) f
      JOIN recipe_lines l ON l.vendor_id = f.vendor_id AND l.menu_name = f.product_name""",
    "past_forecast": _forecast("daily_all", f"({AS_OF} - {q.BACKTEST_DAYS})", q.BACKTEST_DAYS, 60, "vendor_id"),
    "compared": """
      SELECT f.vendor_id, f.date, f.order_count AS predicted_count, coalesce(d.order_count, 0) AS actual_count
      FROM past_forecast f LEFT JOIN daily_all d ON d.vendor_id = f.vendor_id AND d.created_date = f.date""",
    "geo": """
      SELECT s_suppkey AS vendor_id, n_name AS city_name, r_name AS state_name,
        CASE WHEN n_name IS NULL THEN '' ELSE 'City: ' || n_name || ', State: ' || r_name END AS location_text
      FROM supplier LEFT JOIN (
        SELECT s_suppkey AS k, min(near.n_nationkey) AS city FROM supplier JOIN nation home ON home.n_nationkey = s_nationkey
        JOIN nation near ON near.n_regionkey = home.n_regionkey WHERE s_acctbal > 1000 AND near.n_nationkey > 4 GROUP BY s_suppkey) c ON c.k = s_suppkey
      LEFT JOIN nation ON n_nationkey = c.city LEFT JOIN region ON r_regionkey = n_regionkey""",
    "hours": f"""
      SELECT s.vendor_id, s.location_id, {_day_name('s.dow')} AS day_of_week, s.start_time, s.end_time,
        'Site ' || n_name AS location_name, n_name AS company_name, n_name AS city, r_name AS state_name,
        CAST((s.dow + 6) % 7 + 1 AS bigint) AS day_order
      FROM (SELECT vendor_id, location_id, dow, min(start_time) AS start_time, max(end_time) AS end_time
        FROM shifts WHERE active = 1 GROUP BY ALL) s
      JOIN nation ON n_nationkey = s.location_id JOIN region ON r_regionkey = n_regionkey""",
    "week_days": f"""
      SELECT vendor_id, {_day_name('dow')} AS day_of_week, count(*) AS schedules, CAST((dow + 6) % 7 + 1 AS bigint) AS day_order
      FROM shifts WHERE active = 1 GROUP BY vendor_id, dow""",
    "review_parts": f"""
      SELECT vendor_id, comment_date, {_SPREAD} % CAST(ceil(n / 1000) AS bigint) AS part, count(*) AS reviews,
        string_agg(line, chr(10) ORDER BY order_items, review_id) AS review_text
      FROM (SELECT *, count(*) OVER (PARTITION BY vendor_id, comment_date) AS n,
          '- Item: ' || order_items || ' - Rating (out of 5): ' || rating
          || CASE WHEN user_comment <> '' THEN '- Comment: ' || user_comment ELSE '' END AS line
        FROM comments) GROUP BY ALL""",
    "spine": """
      SELECT vendor_id, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS date) AS created_date
      FROM (SELECT vendor_id, min(created_date) AS first_day, max(created_date) AS last_day FROM daily GROUP BY vendor_id)""",
    "filled_spine": """
      SELECT s.vendor_id, s.created_date, d.order_count
      FROM spine s LEFT JOIN daily d ON d.vendor_id = s.vendor_id AND d.created_date = s.created_date""",
    "turns": f"""
      SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer, count(*) OVER (PARTITION BY u.conv_id) AS pairs
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant'""",
    "names": """
      SELECT p_partkey AS id, CASE
        WHEN p_size > 40 THEN p_name || ' ' || lower(p_type)
        WHEN p_size > 25 THEN p_name || ' ' || p_size || ' ml with ' || lower(p_type) || ' ' || CAST(floor(p_retailprice) AS bigint) || '/-'
        WHEN p_size > 10 THEN 'AddOn ' || """ + _title("p_name") + """ || ' & ' || p_type || ' Rs ' || CAST(floor(p_retailprice) AS bigint)
        ELSE p_brand || ' ' || p_name || ' (' || p_size || ' pcs)' END AS name
      FROM part""",
    "flags": f"""
      SELECT id, name, {_squeeze('lower(name)')} AS plain,
        (contains({_squeeze('lower(name)')}, '{q.AMBIGUOUS_WORD}') OR {_squeeze('lower(name)')} IN ({_list(q.VAGUE)}))
          AND {_squeeze('lower(name)')} NOT IN ({_list(lexicons.SPECIFIC_NAMES)}) AS is_ambiguous,
        regexp_matches({_squeeze('lower(name)')}, '{_any(q.BRANDS)}') AND {_squeeze('lower(name)')} NOT IN ({_list(lexicons.NOT_PACKAGED)}) AS is_mrp,
        NOT regexp_matches(regexp_replace(lower(name), '\\b[a-z]+[- ]free\\b', ' ', 'g'), '{_any_plural(q.NON_VEG)}') AS is_veg
      FROM names""",
    "pieces": f"""
      SELECT id, position - 1 AS position, component FROM (
        SELECT id, unnest(parts) AS component, unnest(range(1, len(parts) + 1)) AS position
        FROM (SELECT id, list_filter(list_transform({_segments('name')}, lambda s: {_component('s')}), lambda c: c <> '') AS parts FROM names))""",
    "vocabulary": f"""
      SELECT DISTINCT name FROM (
        SELECT {_stripped('p_name')} AS name FROM part UNION ALL SELECT {_stripped('lower(p_type)')} FROM part) WHERE name <> ''""",
    "roots": f"""
      SELECT p_partkey AS id, p_name AS name, {_component(_replace(_chain('lower(p_name)', *PRICES), text.QUANTITY, chr(92) + '1_' + chr(92) + '2'))} AS root_name,
        embedding
      FROM part LEFT JOIN embeddings ON p_partkey = vec_id""",
    "wanted": "SELECT f.id, e.embedding FROM flags f LEFT JOIN embeddings e ON e.vec_id = f.id WHERE NOT is_ambiguous AND NOT is_mrp",
    "item_neighbours": f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
        SELECT w.id AS query_id, r.id, round(list_cosine_similarity(CAST(w.embedding AS double[]), CAST(r.embedding AS double[])), 6) AS similarity
        FROM wanted w, roots r WHERE w.embedding IS NOT NULL AND r.embedding IS NOT NULL)) WHERE rank <= {menu.CANDIDATES}""",
}


def _split(pieces: str, vocabulary: str) -> str:
    """Pieces made of several vocabulary names cut into the fewest, positions renumbered."""
    return f"""
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY position, part) - 1 AS position, component FROM (
        SELECT id, position, unnest(range(0, len(parts))) AS part, unnest(parts) AS component FROM (
          SELECT x.id, x.position, coalesce(c.parts, [x.component]) AS parts FROM ({pieces}) x LEFT JOIN (
            SELECT component, arg_min(parts, lengths) AS parts FROM (
              WITH RECURSIVE paths AS (
                SELECT component, string_split(component, ' ') AS w, 0 AS done, [] :: VARCHAR[] AS parts, [] :: BIGINT[] AS lengths
                FROM (SELECT DISTINCT component FROM ({pieces}) WHERE component NOT IN (SELECT name FROM {vocabulary}))
                UNION ALL
                SELECT component, w, stop, list_append(parts, span), list_append(lengths, done - stop) FROM (
                  SELECT *, array_to_string(w[done + 1:stop], ' ') AS span FROM (SELECT *, unnest(range(done + 1, len(w) + 1)) AS stop FROM paths))
                WHERE span IN (SELECT name FROM {vocabulary})
              )
              SELECT component, parts, list_prepend(len(parts), lengths) AS lengths FROM paths WHERE done = len(w))
            GROUP BY component) c ON c.component = x.component))"""


def _by_name(components: str, k: int, least: float) -> str:
    """The k closest names of each distinct component among those that share enough words."""
    return f"""
      SELECT component, root_id FROM (
        SELECT *, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN component = root_name THEN 1.0 ELSE round(
            CASE WHEN string_split(component, ' ')[-1] = string_split(root_name, ' ')[-1] THEN least(0.99, share + 0.1) ELSE share END, 6) END DESC,
          root_id) AS place
        FROM (SELECT c.component, r.id AS root_id, r.root_name,
            len(list_intersect(list_distinct(string_split(c.component, ' ')), list_distinct(string_split(r.root_name, ' ')))) /
            len(list_distinct(list_concat(string_split(c.component, ' '), string_split(r.root_name, ' ')))) AS share
          FROM (SELECT DISTINCT component FROM {components} WHERE component <> '') c, roots r WHERE r.root_name <> '')
        WHERE share >= {least})
      WHERE place <= {k}"""


STEPS |= {
    "all_parts": _split("SELECT * FROM pieces", "vocabulary"),
    "root_names": "SELECT DISTINCT root_name AS name FROM roots",
    "wanted_parts": _split("SELECT * FROM pieces WHERE id IN (SELECT id FROM wanted)", "root_names"),
    "by_name": _by_name("wanted_parts", menu.CANDIDATES, names.MIN_SHARE),
    "part_candidates": """
      SELECT item_id, position, component, root_id, coalesce(max(similarity), 0.0) AS similarity FROM (
        SELECT w.id AS item_id, w.position, w.component, n.id AS root_id, n.similarity
        FROM wanted_parts w JOIN item_neighbours n ON n.query_id = w.id
        UNION ALL
        SELECT w.id, w.position, w.component, b.root_id, NULL FROM wanted_parts w JOIN by_name b ON b.component = w.component)
      GROUP BY ALL""",
    "scored": """
      SELECT c.*, r.name, CASE WHEN c.component = r.root_name THEN 1.0 ELSE round(
          CASE WHEN string_split(c.component, ' ')[-1] = string_split(r.root_name, ' ')[-1] THEN least(0.99, share + 0.1) ELSE share END, 6) END AS relevance
      FROM (SELECT c.*, r.root_name AS other,
          len(list_intersect(list_distinct(string_split(c.component, ' ')), list_distinct(string_split(r.root_name, ' ')))) /
          len(list_distinct(list_concat(string_split(c.component, ' '), string_split(r.root_name, ' ')))) AS share
        FROM part_candidates c JOIN roots r ON r.id = c.root_id) c JOIN roots r ON r.id = c.root_id""",
    "reranked": f"""
      SELECT item_id, position, component, root_id, similarity, relevance, rank, name FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id, position ORDER BY relevance DESC, similarity DESC, root_id) AS rank FROM scored)
      WHERE rank <= {menu.CANDIDATES}""",
    "chosen": f"""
      SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY item_id, position ORDER BY relevance DESC, similarity DESC, root_id) AS pick
        FROM reranked s JOIN flags f ON f.id = s.item_id
        WHERE relevance > 0 AND (NOT f.is_veg OR NOT regexp_matches(regexp_replace(lower(s.name), '\\b[a-z]+[- ]free\\b', ' ', 'g'), '{_any_plural(q.NON_VEG)}'))) WHERE pick = 1""",
    "kept": """
      SELECT item_id, position, root_id, name, place FROM (
        SELECT c.*, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, position, root_id) AS place FROM chosen c)
      WHERE place <= (SELECT count(*) FROM wanted_parts w WHERE w.id = item_id)""",
    "mapped": f"""
      SELECT f.id, f.name, {_details('f.name')} AS quantity_details, f.is_ambiguous, f.is_mrp, f.is_veg,
        coalesce(k.root_item_name, '') AS root_item_name, coalesce(k.root_item_ids, '') AS root_item_ids
      FROM flags f LEFT JOIN (
        SELECT item_id, string_agg(name, '{menu.SEPARATOR}' ORDER BY place) AS root_item_name,
          string_agg(CAST(root_id AS varchar), ',' ORDER BY place) AS root_item_ids FROM kept GROUP BY item_id) k ON k.item_id = f.id""",
}


def _with_steps(select: str) -> str:
    """The select with the steps it mentions, theirs included, in order of definition."""
    needed: set[str] = set()
    queue = [select]
    while queue:
        body = queue.pop()
        for name, step in STEPS.items():
            if name not in needed and re.search(rf"(FROM|JOIN|,)\s+{name}\b", body):
                needed.add(name)
                queue.append(step)
    ctes = ", ".join(f"{name} AS ({step})" for name, step in STEPS.items() if name in needed)
    return f"WITH {ctes} {select}" if ctes else select


def _rating_counts(extra: str) -> str:
    return f"SELECT vendor_id, {extra} FROM comments GROUP BY vendor_id"


_TONE = f"{_matches('lower(user_comment)', lexicons.POSITIVE_WORDS)} - {_matches('lower(user_comment)', lexicons.NEGATIVE_WORDS)}"
_ABOUT = _mentions("lower(user_comment)", lexicons.DELIVERY_WORDS)
_BAD = f"{_ABOUT} AND (stars <= 2 OR {_mentions('lower(user_comment)', lexicons.DELIVERY_NEGATIVE_WORDS)})"
_LINE = "CAST(created_date AS varchar) || ': sales ' || printf('%.2f', daily_sales) || ', orders ' || total_orders"
_SUMS = "'sales ' || printf('%.2f', sales) || ', orders ' || orders"
_HISTORY = "'Vendor_Question: ' || question || chr(10) || 'System_Answer: ' || answer"

SELECTS = {
    "scan_tables": "SELECT * FROM items WHERE qty >= 10 AND price < 60000.0",
    "scan_daily_csv": "SELECT created_date AS date, count(*) AS order_count FROM headers GROUP BY created_date",
    "scan_order_csv": """
      SELECT l_suppkey AS vendor_id, l_partkey AS product_id, l_extendedprice AS product_price, CAST(l_shipdate AS date) AS created_date,
        CAST(l_linenumber - 1 AS int) AS order_count, dayname(l_shipdate) AS day_of_week, l_partkey AS location_id,
        CAST(0 AS bigint) AS occasion_id, l_orderkey AS employee_id FROM lineitem""",
    "scan_prompt_csv": """
      SELECT CAST(item_id AS int) AS prompt_id, 'Find "matches" in:' || chr(10) || text AS prompt FROM benchmark""",
    "scan_root_items": """
      SELECT CAST(p_partkey AS varchar) AS id, p_name AS name, p_brand || ',' || p_type AS trace_ids, p_partkey || ',' || p_name AS document FROM part""",
    "scan_review_csv": f"""
      SELECT doc_id % (SELECT count(*) FROM supplier) AS vendor_id, doc_id AS location_id, CAST(0 AS bigint) AS ocassion_id,
        CASE WHEN lang = 'en' THEN (doc_id % (SELECT count(*) FROM part)) || ',' || ((doc_id * 7 + 1) % ((SELECT count(*) FROM part) + 50))
          ELSE CAST(doc_id % (SELECT count(*) FROM part) AS varchar) END AS menu_id,
        source AS menu_name, CAST(n_chars AS double) AS pricing, CAST(1 + doc_id % 5 AS int) AS rating, text AS comment,
        CAST({AS_OF} - CAST(doc_id % 120 AS integer) AS date) AS date
      FROM documents""",
    "expand_orders": """
      SELECT (l_orderkey * 10 + l_linenumber) || '-' || n AS order_ref, l_suppkey AS vendor_id, l_orderkey AS employee_id, l_partkey AS location_id,
        CAST(0 AS bigint) AS occasion_id, l_partkey AS product_id, l_extendedprice AS price, CAST(1 AS bigint) AS qty, 'new' AS status,
        CAST(l_shipdate AS date) AS created_date
      FROM lineitem JOIN range(1, 100) t(n) ON n <= l_linenumber - 1""",
    "normalise_reviews": f"""
      SELECT d.doc_id AS id, d.vendor_id, d.rating, d.order_created_date,
        CASE WHEN ok THEN names END AS order_items, CASE WHEN ok THEN 'text' ELSE 'rejected' END AS type,
        CASE WHEN ok THEN 'user comment' END AS question, d.text AS value
      FROM (
        SELECT d.*, (lang <> 'en' AND a.p_name IS NOT NULL) OR (lang = 'en' AND a.p_name IS NOT NULL AND b.p_name IS NOT NULL AND first <> second) AS ok,
          CASE WHEN lang <> 'en' THEN a.p_name WHEN first < second THEN a.p_name || ', ' || b.p_name ELSE b.p_name || ', ' || a.p_name END AS names
        FROM (SELECT *, doc_id % (SELECT count(*) FROM supplier) AS vendor_id, CAST(1 + doc_id % 5 AS int) AS rating,
            CAST({AS_OF} - CAST(doc_id % 120 AS integer) AS date) AS order_created_date,
            doc_id % (SELECT count(*) FROM part) AS first, (doc_id * 7 + 1) % ((SELECT count(*) FROM part) + 50) AS second FROM documents) d
        LEFT JOIN part a ON a.p_partkey = first LEFT JOIN part b ON b.p_partkey = second) d""",
    "append_missing": """
      SELECT vendor_id, name AS menu_name, 'found for ' || name AS ingredients FROM listed_menu
      GROUP BY vendor_id, name HAVING bool_and(p_type = 'PROMO')""",
    "write_json": """
      SELECT vendor_id, count(*) AS total_reviews,
        round(count(*) FILTER (WHERE stars >= 4) * 100 / count(*), 2) AS positive_review_percentage,
        round(100 - round(count(*) FILTER (WHERE stars >= 4) * 100 / count(*), 2) - round(count(*) FILTER (WHERE stars <= 2) * 100 / count(*), 2), 2) AS neutral_review_percentage,
        round(count(*) FILTER (WHERE stars <= 2) * 100 / count(*), 2) AS negative_review_percentage
      FROM comments GROUP BY vendor_id""",
    "write_lines": "SELECT 'ID,NAME' AS line UNION ALL SELECT p_partkey || ',' || p_name FROM part",
    "write_predictions": """
      SELECT CAST(p_partkey AS int) AS menu_id, p_name AS menu_name, CAST(p_partkey AS int) AS master_menu_id, p_name AS master_menu_name,
        CASE WHEN p_size <= 20 THEN upper(p_name) WHEN p_size <= 40 THEN p_type END AS predicted_menu_name,
        p_size > 25 AS eval_current, CASE WHEN p_size > 30 THEN p_size > 40 END AS is_approved FROM part""",
    "vendors_by_company": "SELECT CAST(s_nationkey AS bigint) AS company_id, s_suppkey AS id, s_name AS vendor_name FROM supplier WHERE s_acctbal > 0",
    "active_menu": "SELECT vendor_id, name, id FROM listed_menu WHERE active = 1",
    "menu_names": "SELECT vendor_id, name FROM listed_menu",
    "trailing_window": f"SELECT * FROM headers WHERE created_date > {AS_OF} - 60",
    "date_between": f"SELECT * FROM headers WHERE created_date BETWEEN {AS_OF} - 400 AND {AS_OF} - 100",
    "status_filter": f"SELECT * FROM headers WHERE status NOT IN ({_list(q.EXCLUDED)})",
    "review_reference_filter": "SELECT id, vendor_id, rating, order_created_date, order_items FROM order_reviews",
    "review_comment_case": "SELECT response_id, review_id, review_option_id, type, segment FROM answers",
    "question_routing": """
      SELECT conv_id, turn, contains(lower(text), 'schedule') AS needs_schedule, contains(lower(text), 'tion') AS needs_menu
      FROM conversations WHERE role = 'user'""",
    "company_list": "SELECT CAST(n_nationkey AS bigint) AS company_id, n_name AS company_name FROM nation",
    "id_watermark": f"SELECT id, {_normal('name')} AS name FROM names WHERE id > 100",
    "parse_rating": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size <= 10 THEN p_size END AS rating FROM part",
    "order_item_join": """
      SELECT h.id AS order_id, h.employee_id, h.status, h.created_date, i.vendor_id, i.product_id, i.qty, i.price
      FROM headers h JOIN items i ON i.order_id = h.id""",
    "order_item_menu_join": """
      SELECT i.product_id, h.id AS order_id, h.employee_id, h.status, h.created_date, i.vendor_id, i.qty, i.price,
        p_name AS product_name, p_retailprice AS menu_price
      FROM headers h JOIN items i ON i.order_id = h.id JOIN part ON p_partkey = i.product_id""",
    "menu_ingredients": """
      SELECT m.vendor_id, m.id AS product_id, m.name AS product_name, l.ingredient, l.measurement_unit, l.measurement_value
      FROM listed_menu m JOIN recipe_lines l ON l.vendor_id = m.vendor_id AND l.menu_name = m.name""",
    "vendor_geo": "SELECT * FROM geo",
    "vendor_schedule_hours": "SELECT * FROM hours",
    "attach_product_id": """
      SELECT n.vendor_id, n.product_id, n.product_name, coalesce(m.id, -1) AS attached_id FROM next_day n
      LEFT JOIN (SELECT vendor_id, name, max(id) AS id FROM listed_menu WHERE active = 1 GROUP BY ALL) m
        ON m.vendor_id = n.vendor_id AND m.name = n.product_name""",
    "predicted_vs_actual": "SELECT * FROM compared",
    "holiday_sales": "SELECT vendor_id, created_date, daily_sales, total_orders FROM revenue WHERE created_date IN (SELECT date FROM holidays)",
    "known_items_only": """
      SELECT CAST(k.p_partkey AS varchar) AS id, x.p_name AS predicted_name, k.p_name AS root_name
      FROM part x JOIN part k ON k.p_partkey = x.p_partkey * 2""",
    "items_without_ingredients": "SELECT vendor_id, name FROM listed_menu GROUP BY vendor_id, name HAVING bool_and(p_type = 'PROMO')",
    "predictions_with_ingredients": """
      SELECT vendor_id, product_name, order_count, ingredient, measurement_unit, measurement_value FROM forecast_lines""",
    "product_image_url": """
      SELECT p_partkey AS product_id, CASE WHEN p_size <= 40 THEN 'https://images.example.org/menu-bucket/resize_images/' || lower(p_type)
        || '/original_' || CASE WHEN p_size <= 20 THEN 'a.jpg' ELSE 'b.jpg' END END AS image_url FROM part""",
    "vendor_daily_orders": "SELECT * FROM daily",
    "vendor_daily_orders_range": f"""
      SELECT *, count(*) OVER (PARTITION BY vendor_id) AS data_points, count(*) OVER (PARTITION BY vendor_id) >= 170 AS enough_history
      FROM daily_all WHERE created_date BETWEEN {AS_OF} - 395 AND {AS_OF}""",
    "product_daily_qty": f"""
      SELECT product_id, created_date, CAST(sum(qty) AS bigint) AS order_count FROM headers h JOIN items i ON i.order_id = h.id
      WHERE created_date > {AS_OF} - 60 GROUP BY product_id, created_date""",
    "product_daily_counts": "SELECT * FROM product_days",
    "item_sales_price": "SELECT * FROM item_days",
    "daily_revenue": "SELECT * FROM revenue",
    "schedule_by_day": "SELECT * FROM week_days",
    "review_comments": "SELECT review_id, vendor_id, order_items, rating, comment_date, user_comment FROM comments",
    "repeat_customers": f"""
      SELECT s_suppkey AS vendor_id, coalesce(total, 0) AS total_customers, CAST(coalesce(again, 0) AS bigint) AS repeating_customers,
        CASE WHEN total > 0 THEN round(again / total * 100, 2) ELSE 0.0 END AS repeating_customers_percentage
      FROM supplier LEFT JOIN (
        SELECT vendor_id, count(employee_id) AS total, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS again FROM (
          SELECT vendor_id, employee_id, count(*) AS n FROM sales WHERE created_date > {AS_OF} - 90 AND status <> 'cancelled' GROUP BY ALL)
        GROUP BY vendor_id) c ON c.vendor_id = s_suppkey""",
    "monthly_revenue": "SELECT *, round(sales / 30, 4) AS avg_daily_sales, round(orders / 30, 4) AS avg_daily_orders FROM months",
    "revenue_totals": "SELECT *, round(sales / 90, 4) AS avg_daily_sales FROM totals",
    "revenue_rollup": """
      SELECT vendor_id, strftime(created_date, '%Y-%m') AS month, created_date, 'day' AS level, daily_sales AS sales,
        total_orders AS orders, CAST(NULL AS double) AS avg_daily_sales FROM revenue
      UNION ALL SELECT vendor_id, month, NULL, 'month', sales, orders, round(sales / 30, 4) FROM months
      UNION ALL SELECT vendor_id, NULL, NULL, 'total', sales, orders, round(sales / 90, 4) FROM totals""",
    "item_total_orders": "SELECT * FROM item_totals",
    "item_rating": "SELECT * FROM ratings",
    "sentiment_breakdown": """
      SELECT *, round(100 - positive_review_percentage - negative_review_percentage, 2) AS neutral_review_percentage FROM (
        SELECT vendor_id, round(count(*) FILTER (WHERE stars >= 4) * 100 / count(*), 2) AS positive_review_percentage,
          round(count(*) FILTER (WHERE stars <= 2) * 100 / count(*), 2) AS negative_review_percentage FROM comments GROUP BY vendor_id)""",
    "price_complaints": _rating_counts(
        f"count(*) FILTER (WHERE {_mentions('lower(user_comment)', lexicons.PRICE_WORDS)}) AS high_price_complain_reviews"
    ),
    "sentiment_score": f"""
      SELECT vendor_id, count(*) AS scored_reviews, CAST(0 AS bigint) AS excluded_reviews, round(greatest(0.0, least(100.0, (
          7 * (sum(14 * stars + CASE WHEN user_comment <> '' THEN 4 * tone ELSE 0 END) / count(*))
          + 3 * coalesce(avg(CASE WHEN user_comment <> '' THEN greatest(0, least(100, 20 * tone + 50)) END), 0.0)) / 10)), 2) AS sentiment_score
      FROM (SELECT *, {_TONE} AS tone FROM comments) GROUP BY vendor_id""",
    "delivery_sentiment": f"""
      SELECT *, CASE WHEN total_mentions = 0 THEN 'neutral' WHEN negative_mentions / total_mentions > 0.3 THEN 'negative' ELSE 'positive' END AS sentiment,
        CASE WHEN total_mentions > 0 THEN round(negative_mentions * 100 / total_mentions, 2) ELSE 0.0 END AS negative_review_percentage
      FROM (SELECT vendor_id, count(*) FILTER (WHERE {_ABOUT}) AS total_mentions, count(*) FILTER (WHERE {_BAD}) AS negative_mentions
        FROM comments GROUP BY vendor_id)""",
    "item_review_ratios": "SELECT * FROM ratios",
    "total_reviews": _rating_counts("count(*) AS total_reviews"),
    "ration_requirements": """
      SELECT vendor_id, ingredient, first(measurement_unit ORDER BY first_date, first_product, product_name, position) AS measurement_unit,
        round(sum(measurement_value * order_count), 4) AS measurement_value,
        array_to_string(list_sort(list(DISTINCT product_name)), ', ') AS products, count(DISTINCT measurement_unit) > 1 AS unit_conflict
      FROM forecast_lines GROUP BY vendor_id, ingredient""",
    "forecast_backtest": """
      SELECT vendor_id, date, predicted_count, actual_count, absolute_error, round(pct, 4) AS difference_percentage,
        round(median(pct) OVER v, 4) AS median_value, round(avg(absolute_error) OVER v, 4) AS mean_absolute_error,
        round(CAST(sum(absolute_error) OVER v AS double) / nullif(sum(actual_count) OVER v, 0), 4) AS error_to_actual
      FROM (SELECT *, abs(predicted_count - actual_count) AS absolute_error,
          CASE WHEN predicted_count > 0 THEN abs(predicted_count - actual_count) / predicted_count * 100 ELSE 0.0 END AS pct FROM compared)
      WINDOW v AS (PARTITION BY vendor_id)""",
    "reviews_by_date": "SELECT * FROM review_parts",
    "refresh_daily": "SELECT * FROM daily_all",
    "max_updated_at": "SELECT l_suppkey AS vendor_id, max(CAST(l_shipdate AS date)) AS max_updated_at FROM lineitem GROUP BY l_suppkey",
    "best_worst_selling": "SELECT vendor_id, menu_name, position, orders, price, rating FROM performance",
    "best_worst_item": """
      SELECT vendor_id, first(order_items ORDER BY positive_neutral_percentage DESC, reviews DESC, order_items) AS best_item,
        max(positive_neutral_percentage) AS best_positive_neutral_percentage,
        first(order_items ORDER BY negative_percentage DESC, reviews DESC, order_items) AS worst_item, max(negative_percentage) AS worst_negative_percentage
      FROM ratios GROUP BY vendor_id""",
    "ffill_daily": """
      SELECT vendor_id, created_date, last_value(order_count IGNORE NULLS) OVER (PARTITION BY vendor_id ORDER BY created_date
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS order_count FROM filled_spine""",
    "next_day_change": """
      SELECT *, CASE WHEN last_day_order_count = 0 THEN 0.0
        ELSE round(100 * (this_day_prediction - last_day_order_count) / last_day_order_count, 2) END AS increase_percentage FROM next_day""",
    "topk_per_query": f"""
      SELECT query_id, id, similarity, CAST(rank AS int) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
          SELECT e.vec_id AS query_id, r.id, round(list_cosine_similarity(CAST(e.embedding AS double[]), CAST(r.embedding AS double[])), 6) AS similarity
          FROM embeddings e JOIN part ON p_partkey = e.vec_id, roots r WHERE r.embedding IS NOT NULL)) WHERE rank <= {menu.CANDIDATES}""",
    "component_limit": "SELECT item_id, CAST(position AS int) AS position, root_id, name, CAST(place AS int) AS place FROM kept",
    "sentence_windows": r"""
      SELECT doc_id, CAST(i - 1 AS int) AS position, s[i] AS sentence, array_to_string(s[greatest(i - 2, 1):i + 2], ' ') AS "window"
      FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents))""",
    "session_turns": "SELECT *, pairs < 7 AS history_used FROM turns",
    "unanswered_turns": """
      SELECT u.conv_id, u.turn, u.text AS question FROM conversations u LEFT JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND a.conv_id IS NULL""",
    "session_history": f"""
      SELECT conv_id, turn // 100 AS part, pairs < 7 AS history_used, string_agg({_HISTORY}, chr(10) ORDER BY turn) AS history
      FROM turns GROUP BY ALL""",
    "candidate_union": "SELECT item_id, CAST(position AS int) AS position, component, root_id, similarity FROM part_candidates",
    "daily_spine": "SELECT * FROM filled_spine",
    "dow_features": "SELECT *, "
    + ", ".join(f"CAST(isodow(created_date) = {k + 1} AS double) AS dow_{k}" for k in range(1, 7))
    + " FROM daily",
    "forecast_frame": "SELECT *, "
    + ", ".join(f"CAST(isodow(created_date) = {k + 1} AS double) AS dow_{k}" for k in range(1, 7))
    + """ FROM (SELECT vendor_id, CAST(last_day + CAST(unnest(range(1, 29)) AS integer) AS date) AS created_date
        FROM (SELECT vendor_id, max(created_date) AS last_day FROM daily GROUP BY vendor_id))""",
    "holiday_features": """
      SELECT d.*, h.holiday, CAST(coalesce(h.weightage, 0) AS int) AS weightage FROM daily d LEFT JOIN (
        SELECT date, first(holiday ORDER BY weightage DESC, holiday DESC) AS holiday, max(weightage) AS weightage FROM holidays GROUP BY date
      ) h ON h.date = d.created_date""",
    "seasonal_forecast": _forecast("daily_all", AS_OF, q.HORIZON, 60, "vendor_id"),
    "product_forecast": f"""
      SELECT f.vendor_id, f.product_id, f.date, f.order_count, m.name AS product_name, r.kind || ', ' || r.brand AS ingredients,
        coalesce(c.reviews, 0) AS reviews, c.average_rating
      FROM ({_forecast("(SELECT vendor_id, product_id, created_date, sum(qty) AS order_count FROM headers h JOIN items i ON i.order_id = h.id GROUP BY ALL)", AS_OF, 30, 60, "vendor_id, product_id", scheduled=False)}) f
      JOIN listed_menu m ON m.vendor_id = f.vendor_id AND m.id = f.product_id
      JOIN recipes r ON r.vendor_id = f.vendor_id AND r.menu_name = m.name
      LEFT JOIN (SELECT vendor_id, order_items, count(*) AS reviews, round(avg(stars), 4) AS average_rating FROM comments GROUP BY ALL) c
        ON c.vendor_id = f.vendor_id AND c.order_items = m.name""",
    "item_level_forecast": "SELECT * FROM item_forecast",
    "normalize_name": f"SELECT id, name, {_normal('name')} AS normalized FROM names",
    "spell_correct": "SELECT p_partkey AS id, "
    + _spell("p_name", {"gizmo": "gadget", "anvil": "block", "rod": "bar"})
    + " AS corrected FROM part",
    "spell_correct_free": f"""
      WITH counted AS (
        SELECT known, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS known FROM part) GROUP BY known
        UNION ALL SELECT 'bult', 0
      ), each AS (
        SELECT id, unnest(w) AS word, unnest(range(len(w))) AS place FROM (
          SELECT p_partkey AS id, string_split(CASE p_partkey % 4 WHEN 1 THEN p_name[1:1] || p_name[3:] WHEN 2 THEN p_name || p_name[-1:]
            WHEN 3 THEN regexp_replace(p_name, 'i|o', 'u', 'g') ELSE p_name END, ' ') AS w FROM part)
      ), nearest AS (
        SELECT word, arg_min(known, [distance, -n, place]) AS corrected FROM (
          SELECT e.word, c.known, c.n, levenshtein(e.word, c.known) AS distance, row_number() OVER (ORDER BY c.known) AS place
          FROM (SELECT DISTINCT word FROM each) e, counted c
          WHERE length(c.known) BETWEEN {names.ONE_ERROR} AND {names.LONGEST} AND regexp_full_match(e.word, '[a-z'']{{2,}}')
            AND length(e.word) <= {names.LONGEST} AND e.word NOT IN (SELECT known FROM counted))
        WHERE distance <= CASE WHEN length(known) >= {names.TWO_ERRORS} THEN 2 ELSE 1 END GROUP BY word
      )
      SELECT id, string_agg(coalesce(corrected, e.word), ' ' ORDER BY place) AS corrected
      FROM each e LEFT JOIN nearest s ON s.word = e.word GROUP BY id""",
    "name_candidates": _by_name("pieces", menu.PLAIN_CANDIDATES, 0.3),
    "strip_noise": f"SELECT id, name, {_stripped('name')} AS stripped FROM names",
    "split_components": "SELECT id, CAST(position AS int) AS position, component FROM all_parts",
    "quantity_details": f"SELECT id, name, {_details('name')} AS quantity_details FROM names",
    "is_ambiguous": "SELECT id, name, is_ambiguous FROM flags",
    "is_mrp": "SELECT id, name, is_mrp FROM flags",
    "is_veg": "SELECT id, name, is_veg FROM flags",
    "title_case": f"SELECT p_partkey AS id, {_title('p_name')} AS title FROM part",
    "cosine_topk": f"""
      SELECT query_id, id, similarity, CAST(rank AS int) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
          SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS double[]), CAST(b.embedding AS double[])), 6) AS similarity
          FROM embeddings a, embeddings b)) WHERE rank <= {menu.PLAIN_CANDIDATES}""",
    "ann_topk_fixed": f"""
      SELECT * FROM (WITH units AS (
        SELECT vec_id AS id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v
        FROM (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings)
      ), dots AS (
        SELECT id, j AS cell, 0.5 * list_sum(v[4 * j + 1:4 * j + 4]) AS dot FROM units, range(16) r(j)
      ), assigned AS (
        SELECT id, arg_max(cell, dot) AS cell FROM dots GROUP BY id
      ), coded AS (
        SELECT id, cell, list_transform(range(1, 65), lambda i:
          CASE WHEN v[i] - CASE WHEN (i - 1) // 4 = cell THEN 0.5 ELSE 0 END > 0 THEN {q.CODE_STEP} ELSE -{q.CODE_STEP} END) AS code
        FROM units JOIN assigned USING (id)
      ), held AS (
        SELECT cell, count(*) AS n FROM assigned GROUP BY cell
      ), visited AS (
        SELECT n.id, n.cell, n.dot,
          coalesce(sum(h.n) OVER (PARTITION BY n.id ORDER BY n.dot DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            < {menu.PLAIN_CANDIDATES} AS nearest
        FROM dots n JOIN held h USING (cell)
      ), ranked_codes AS (
        SELECT v.id AS query_id, c.id, v.nearest, round_even((v.dot + {q.CODE_REACH}) * 1e6, 0) AS likely,
          round_even((v.dot + list_inner_product(r.v, c.code)) * 1e6, 0) AS score
        FROM visited v JOIN coded c USING (cell) JOIN units r ON r.id = v.id
      ), floors AS (
        SELECT query_id, min(score) AS least FROM (
          SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS i FROM ranked_codes WHERE nearest
        ) WHERE i <= {menu.PLAIN_CANDIDATES} GROUP BY query_id
      ), shortlist AS (
        SELECT query_id, id FROM ranked_codes JOIN floors USING (query_id) WHERE nearest OR likely >= least
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {10 * menu.PLAIN_CANDIDATES}
      ), matches AS (
        SELECT s.query_id, s.id, round(list_inner_product(a.v, b.v), 6) AS similarity
        FROM shortlist s JOIN units a ON a.id = s.query_id JOIN units b ON b.id = s.id
      )
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS int) AS rank FROM matches
      QUALIFY rank <= {menu.PLAIN_CANDIDATES})""",
    "rerank": "SELECT item_id, CAST(position AS int) AS position, component, root_id, similarity, relevance, CAST(rank AS int) AS rank FROM reranked",
    "map_to_root_items": "SELECT * FROM mapped",
    "attach_nutrition": f"""
      SELECT id, CAST(i - 1 AS int) AS position, a[i] AS quantity_component, b[i] AS root_item, energy FROM (
        SELECT id, a, b, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM (
          SELECT id, string_split(quantity_details, ' | ') AS a, string_split(root_item_name, ' | ') AS b FROM mapped
          WHERE quantity_details <> '' AND root_item_name <> ''))
      LEFT JOIN (SELECT {_title('p_name')} AS title, max(p_size) AS energy FROM part GROUP BY ALL) n ON n.title = a[i]""",
    "evaluate_mapping": """
      SELECT p_name AS master_menu_name, count(*) AS predictions, count(*) FILTER (WHERE p_size > 40) AS not_judged,
        round(avg(CASE WHEN p_size <= 20 THEN 1 WHEN p_size <= 40 THEN CAST(lower(p_type) = p_name AS int) END), 4) AS match_rate
      FROM part GROUP BY p_name""",
    "llm_batch": "SELECT conv_id, turn, length(text) || ' characters' AS completion FROM conversations",
    "render_prompt": """
      SELECT s_suppkey AS vendor_id, 'Holidays:' || chr(10)
        || (SELECT string_agg(concat_ws(', ', CAST(date AS varchar), holiday, region, CAST(weightage AS varchar)), chr(10) ORDER BY date, holiday) FROM holidays)
        || chr(10) || g.location_text || chr(10) || 'Vendor schedule:' || chr(10) || coalesce(s.schedule, '') || chr(10) || 'Historical data:' || chr(10)
        || coalesce(d.history, '') || chr(10) || 'Predict the next 14 days.' AS prompt
      FROM supplier JOIN geo g ON g.vendor_id = s_suppkey
      LEFT JOIN (SELECT vendor_id, string_agg(created_date || ': ' || order_count, chr(10) ORDER BY created_date) AS history FROM daily GROUP BY vendor_id) d ON d.vendor_id = s_suppkey
      LEFT JOIN (SELECT vendor_id, string_agg(day_of_week || ': ' || schedules, chr(10) ORDER BY day_order) AS schedule FROM week_days GROUP BY vendor_id) s ON s.vendor_id = s_suppkey""",
    "render_feedback": f"""
      SELECT vendor_id, order_items, {_SPREAD} % CAST(ceil(n / 200) AS bigint) AS part, 'Rating, comment:' || chr(10)
        || string_agg(rating || ', ' || user_comment, chr(10) ORDER BY comment_date, review_id) || chr(10) || 'Summarise the feedback in three points.' AS prompt
      FROM (SELECT *, count(*) OVER (PARTITION BY vendor_id, order_items) AS n FROM comments) GROUP BY ALL""",
    "prompt_cache": """
      SELECT conv_id, turn, md5(text) AS prompt_md5, CASE WHEN newest * 60 < 7200 THEN 'stored ' || md5(text) ELSE left(md5(text), 8) END AS response,
        newest * 60 < 7200 AS cache_hit
      FROM (SELECT *, min(conv_id) OVER (PARTITION BY text) AS newest FROM conversations WHERE role = 'user')""",
    "parse_structured": """
      SELECT event_id, CAST(json_extract(props, '$.k') AS bigint) AS k, json_extract(props, '$.k') IS NOT NULL AS valid FROM events""",
    "answer_violations": """
      SELECT * FROM (WITH forecast_days AS (
        SELECT l_orderkey AS o, l_linenumber AS l, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM lineitem
      ), forecast_rows AS (
        SELECT *, '$.order_data[' || i || ']' AS p, o % 11 = 4 AND l = 2 AS seven FROM forecast_days WHERE o % 13 > 1
      )
      SELECT DISTINCT o AS order_id, '$' AS path, 'not json' AS problem FROM forecast_days WHERE o % 13 = 0
      UNION ALL SELECT DISTINCT o, '$.order_data', 'not an array' FROM forecast_days WHERE o % 13 = 1
      UNION ALL SELECT DISTINCT o, '$.reasoning', 'not a string' FROM forecast_days WHERE o % 13 = 1
      UNION ALL SELECT DISTINCT o, '$.reasoning', 'missing' FROM forecast_rows WHERE o % 4 = 2
      UNION ALL SELECT o, p, 'not an object' FROM forecast_rows WHERE seven
      UNION ALL SELECT o, p || '.date', 'missing' FROM forecast_rows WHERE NOT seven AND o % 3 = 1 AND l % 4 = 1
      UNION ALL SELECT o, p || '.order_count', CASE o % 5 WHEN 2 THEN 'missing' ELSE 'not an integer' END FROM forecast_rows
        WHERE NOT seven AND ((o % 5 = 1 AND l % 2 = 0) OR (o % 5 = 2 AND l % 3 = 0) OR (o % 5 = 3 AND l % 2 = 1)))""",
    "parse_fenced_json": f"""
      SELECT p_partkey, CASE WHEN p_size <= 40 THEN CAST(p_partkey AS varchar) ELSE '-1' END AS item_id,
        CASE WHEN p_size <= 20 THEN p_name WHEN p_size <= 40 THEN p_name || '''s' ELSE 'LLM JSON parsing failed' END AS item_name FROM part
      UNION ALL SELECT p_partkey, '-7', 'x' FROM part WHERE p_size <= 20""",
    "retry": """
      SELECT p_partkey AS id, p_name AS prompt, CASE WHEN length(p_name) <= 22 THEN upper(p_name) END AS completion,
        CASE WHEN length(p_name) > 22 THEN 'ValueError: prompt too long' END AS error FROM part""",
    "vendor_context": f"""
      SELECT s_suppkey AS vendor_id, 'vendor' AS block, CAST(0 AS bigint) AS section, CAST(0 AS bigint) AS part, 'Vendor Name: ' || s_name || chr(10)
        || 'Vendor Description: Balance ' || CAST(CAST(s_acctbal AS {MONEY}) AS varchar) AS text FROM supplier
      UNION ALL SELECT vendor_id, 'total_revenue', 0, 0, {_SUMS} FROM totals
      UNION ALL SELECT vendor_id, 'monthly_revenue', 0, 0, string_agg(month || ': ' || {_SUMS}, chr(10) ORDER BY month) FROM months GROUP BY vendor_id
      UNION ALL SELECT vendor_id, 'daily_revenue', 0, 0, string_agg({_LINE}, chr(10) ORDER BY created_date) FROM revenue GROUP BY vendor_id
      UNION ALL SELECT vendor_id, 'holiday_sales', 0, 0, string_agg({_LINE}, chr(10) ORDER BY created_date) FROM revenue
        WHERE created_date IN (SELECT date FROM holidays) GROUP BY vendor_id
      UNION ALL SELECT vendor_id, 'item_performance', 0, 0, string_agg(upper(position[1:1]) || position[2:] || ' selling item: ' || menu_name || ': ' || orders
        || ' orders, Price: ₹' || printf('%.2f', price), chr(10) ORDER BY position) FROM performance GROUP BY vendor_id
      UNION ALL SELECT vendor_id, 'schedule', 0, 0, string_agg(concat_ws(', ', day_of_week, start_time, end_time, location_name, company_name, city, state_name),
        chr(10) ORDER BY day_order, location_id) FROM hours GROUP BY vendor_id
      UNION ALL SELECT vendor_id, 'reviews', comment_date - date '1970-01-01', part,
        'Review Date: ' || CAST(comment_date AS varchar) || chr(10) || review_text FROM review_parts
      UNION ALL SELECT conv_id % (SELECT count(*) FROM supplier), CASE WHEN pairs < 7 THEN 'history' ELSE 'long_history' END,
        conv_id, turn // 100, string_agg({_HISTORY}, chr(10) ORDER BY turn) FROM turns GROUP BY conv_id, turn // 100, pairs""",
}

SQL = {name: _with_steps(select) for name, select in SELECTS.items()}
