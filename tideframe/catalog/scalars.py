"""2.9 Scalar functions."""

from pyspark.sql import Window, functions as F

from tideframe.catalog import fin, query
from tideframe.functions import rolling as R, scalar as C, taxonomy as G, text as X
from tideframe.operators import asof as A, panel as P, statements as ST
from tideframe.plans.fixtures import BARS, BRAND, DRIVERS, MARKET, RISK, WEEKDAYS, WEEKLY

GROUPS = [g for gs in G.BASKET_OF_GROUP.values() for g in gs] + ["Unknown"]


def codes(t):
    """Raw code texts in every notation the rules know, one per customer."""
    k = F.col("c_custkey")
    d6, d4 = F.lpad(k.cast("string"), 6, "0"), F.lpad((k % 10000).cast("string"), 4, "0")
    forms = [F.concat(F.lit("A"), d6), F.concat(d6, F.lit("KS")), F.concat(F.lit(" "), d6, F.lit(".KQ ")), F.concat(d4, F.lit("HK")),
             F.concat(d4, F.lit("T")), F.concat(F.lit("brk/"), k.cast("string")), d6, F.concat(F.lit("sap"), F.lit("DE"))]
    return t.customer.select(F.col("c_custkey").alias("id"), F.element_at(F.array(*forms), (k % 8 + 1).cast("int")).alias("code"))


_D6, _D4 = "lpad(c_custkey::VARCHAR,6,'0')", "lpad((c_custkey%10000)::VARCHAR,4,'0')"
CODES = f"""(SELECT c_custkey AS id, [ 'A'||{_D6}, {_D6}||'KS', ' '||{_D6}||'.KQ ', {_D4}||'HK', {_D4}||'T', 'brk/'||c_custkey::VARCHAR, {_D6}, 'sapDE'][(c_custkey%8+1)::INT] AS code FROM customer)"""
_NORM = "regexp_replace(upper(trim(code)),'^A','')"
_CC = """CASE WHEN regexp_full_match(u,'A[0-9]{6}') THEN u[2:7] WHEN regexp_full_match(u,'[0-9]{6}(KS|KQ|SZ|SS)') THEN u[1:6]||'.'||u[7:8]
 WHEN regexp_full_match(u,'[0-9]{4,5}HK') THEN regexp_extract(u,'^([0-9]+)HK$',1)||'.HK' WHEN regexp_full_match(u,'[0-9]{4}T') THEN u[1:4]||'.T'
 WHEN regexp_full_match(u,'[0-9]{4,6}[.](KS|KQ|SZ|SS|HK|T)') THEN u ELSE replace(u,'/','-') END"""


@query("fn01_symbol_normalisation", fin("id:i sym:s plain:s", f"SELECT id, CASE WHEN contains({_NORM},'.') THEN {_NORM} ELSE {_NORM}||'.KS' END AS sym, regexp_replace({_NORM},'[^0-9A-Z]','','g') AS plain FROM {CODES}"))
def _(t):
    return codes(t).select("id", X.asset_symbol("code").alias("sym"), X.plain_code("code").alias("plain"))


@query("fn02_exchange_suffix_rules", fin("id:i code:s ticker:s", f"SELECT id, c AS code, CASE WHEN regexp_full_match(c,'[0-9]{{6}}') THEN c||'.KS' ELSE c END AS ticker FROM (SELECT id, {_CC} AS c FROM (SELECT id, upper(trim(code)) AS u FROM {CODES}))"))
def _(t):
    return codes(t).select("id", X.component_code("code").alias("c"), X.component_ticker("code").alias("ticker")).withColumnRenamed("c", "code")


@query("fn03_suffix_candidates", fin("id:i flip:s cand:s", f"""SELECT id, CASE WHEN c LIKE '%.KS' THEN c[1:-4]||'.KQ' WHEN c LIKE '%.KQ' THEN c[1:-4]||'.KS' ELSE c END AS flip,
 array_to_string(list_filter([{','.join(f"CASE WHEN suffix(c,'{s}') AND length(c)>{len(s) + 1} THEN c[1:-{len(s) + 1}]||'.{s}' END" for s in X.GLUED_SUFFIXES)},
 CASE WHEN regexp_full_match(c,'[0-9]{{6}}[.]KS') THEN c[1:-4]||'.KQ' WHEN regexp_full_match(c,'[0-9]{{6}}[.]KQ') THEN c[1:-4]||'.KS' END], lambda x: x IS NOT NULL),'|') AS cand
 FROM (SELECT id, upper(trim(code)) AS c FROM {CODES})"""))
def _(t):
    c = codes(t).select("id", F.upper(F.trim("code")).alias("c"))
    return c.select("id", X.flip_suffix("c").alias("flip"), F.array_join(X.implied_candidates("c"), "|").alias("cand"))


_NM = "(SELECT p_partkey AS id, p_name||' ('||p_type||') Corp. Class A' AS nm, p_name, p_type FROM part)"


def names(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(") Corp. Class A")).alias("nm"), "p_name", "p_type")


_MN = "upper(regexp_replace({}, '\\s+|\\(.*?\\)|\\[.*?\\]', '', 'g'))"


@query("fn04_name_cleanup", fin("id:i key:s search:s", f"SELECT id, {_MN.format('nm')} AS key, trim(regexp_replace('(dup) '||nm,'^\\(dup\\)\\s*','')) AS search FROM {_NM}"))
def _(t):
    return names(t).select("id", X.match_name("nm").alias("key"), X.search_name(F.concat(F.lit("(dup) "), "nm")).alias("search"))


@query("fn05_latin_script_test", fin("id:i latin:i", "SELECT doc_id AS id, regexp_matches(text,'[A-Za-z]') AND NOT regexp_matches(text,'[가-힣]') AS latin FROM documents"))
def _(t):
    return t.documents.select(F.col("doc_id").alias("id"), X.latin_only("text").alias("latin"))


@query("fn06_name_match_score", fin("id:i s:i", f"""SELECT id, CASE WHEN a=b THEN 3 WHEN b<>'' AND contains(upper(replace(p_type,' ','')),b) THEN 2 WHEN contains(b,a) OR contains(a,b) THEN 1 ELSE 0 END AS s
 FROM (SELECT id, p_type, {_MN.format('p_name')} AS a, {_MN.format("CASE WHEN id%3=0 THEN p_name WHEN id%3=1 THEN p_type ELSE p_name||' plus' END")} AS b FROM {_NM})"""))
def _(t):
    probe = F.when(F.col("id") % 3 == 0, F.col("p_name")).when(F.col("id") % 3 == 1, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" plus")))
    return names(t).select("id", X.match_score("p_name", probe, "p_type").alias("s"))


@query("fn07_name_aliases", fin("alias:s n:i", f"""SELECT alias, count(*) AS n FROM (SELECT id, unnest(list_distinct([b, upper(b), p, upper(p), upper(bare), {','.join(f"upper(st||'{s}')" for s in ['', *X.ALIAS_SUFFIXES])}])) AS alias
 FROM (SELECT *, trim(regexp_replace(bare,'\\b(CORPORATION|CORP|INC|COMPANY|CO|LTD|PLC)[.]?$','','i')) AS st FROM (SELECT *, regexp_replace(p,'[.,]','','g') AS bare FROM
 (SELECT id, trim(nm) AS b, trim(regexp_replace(nm,'\\s+Class\\s+[A-Z]$','','i')) AS p FROM {_NM})))) GROUP BY alias"""))
def _(t):
    return names(t).select(F.explode(X.name_aliases("nm")).alias("alias")).groupBy("alias").agg(F.count(F.lit(1)).alias("n"))


_GL = "[" + ",".join(f"'{g}'" for g in GROUPS) + "]"
_GN = f"(SELECT c_custkey AS id, {_GL}[(c_custkey%{len(GROUPS)}+1)::INT] AS g, ['회사채 funds','단기 CD','plain'][(c_custkey%3+1)::INT] AS nm FROM customer)"


def grouped_names(t):
    k = F.col("c_custkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    return t.customer.select(k.alias("id"), pick(GROUPS, len(GROUPS)).alias("g"), pick(["회사채 funds", "단기 CD", "plain"], 3).alias("nm"))


_BK = "CASE WHEN g='US long bonds' AND contains(nm,'회사채') THEN '해외채권_회사채' WHEN g='Korea bonds' AND contains(nm,'회사채') THEN '국내채권_회사채' WHEN g='Korea bonds' AND contains(nm,'CD') THEN '금리연계형 및 초단기채권' " + " ".join(
    "WHEN g IN ({}) THEN '{}'".format(",".join(f"'{x}'" for x in gs), b) for b, gs in G.BASKET_OF_GROUP.items()) + " ELSE '기타' END"


@query("fn08_basket_classification", fin("id:i basket:s", f"SELECT id, {_BK} AS basket FROM {_GN}"))
def _(t):
    return grouped_names(t).select("id", G.basket("g", "nm").alias("basket"))


@query("fn09_basket_order", fin("id:i k:i", "SELECT id, coalesce(list_position([" + ",".join(f"'{b}'" for b in G.BASKETS) + f"], {_BK})-1, 10) AS k FROM {_GN}"))
def _(t):
    return grouped_names(t).select("id", G.basket_order(G.basket("g", "nm")).alias("k"))


@query("fn10_amount_parsing", fin("id:i v", """SELECT o_orderkey AS id, CASE o_orderkey%4 WHEN 0 THEN NULL WHEN 1 THEN -round(o_totalprice*100)/100 ELSE round(o_totalprice*100)/100 END AS v FROM orders"""))
def _(t):
    k = F.col("o_orderkey")
    num = F.format_number("o_totalprice", 2)
    txt = F.when(k % 4 == 0, F.lit("-")).when(k % 4 == 1, F.concat(F.lit("("), num, F.lit(")"))).otherwise(num)
    return t.orders.select(k.alias("id"), X.amount(txt).alias("v"))


@query("fn11_weight_parsing", fin("id:i w", "SELECT l_orderkey*10+l_linenumber AS id, CASE WHEN l_quantity*0.04>1 THEN l_quantity*0.04/100 ELSE l_quantity*0.04 END AS w FROM lineitem"))
def _(t):
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), X.weight((F.col("l_quantity") * F.lit(0.04)).cast("string")).alias("w"))


@query("fn12_date_normalisation", fin("id:i d:s", "SELECT o_orderkey AS id, strftime(o_orderdate,'%Y-%m-%d') AS d FROM orders"))
def _(t):
    k = F.col("o_orderkey")
    txt = F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return t.orders.select(k.alias("id"), X.iso_date(txt).alias("d"))


@query("fn13_period_ends", fin("freq:s date", f"SELECT 'W' AS freq, max(date) AS date FROM {MARKET} GROUP BY {WEEKDAYS.format(d='date')} UNION ALL SELECT 'M', max(date) FROM {MARKET} GROUP BY date_trunc('month',date) UNION ALL SELECT 'Y', max(date) FROM {MARKET} GROUP BY date_trunc('year',date)"))
def _(t):
    parts = [P.rebalance_dates(t.market, f).select(F.lit(f).alias("freq"), "date") for f in "WMY"]
    return parts[0].union(parts[1]).union(parts[2])


@query("fn14_next_trade_date", fin("date next_date", f"SELECT date, coalesce(lead(date,5) OVER (ORDER BY date), max(date) OVER ()) AS next_date FROM {MARKET}"))
def _(t):
    return P.next_trade_date(t.market, 5)


_REP = """(SELECT make_date(y::INT,4,1) AS available, 'annual' AS kind, y-1 AS fiscal FROM range(1990,2010) r(y) UNION ALL SELECT make_date(y::INT,5,16),'q1',y FROM range(1990,2010) r(y)
 UNION ALL SELECT make_date(y::INT,8,16),'half',y FROM range(1990,2010) r(y) UNION ALL SELECT make_date(y::INT,11,16),'q3',y FROM range(1990,2010) r(y))"""


@query("fn15_report_availability", fin("date kind:s fiscal:i", f"SELECT m.date, arg_max(kind, available) AS kind, arg_max(fiscal, available) AS fiscal FROM {MARKET} m JOIN {_REP} r ON r.available<=m.date GROUP BY m.date"))
def _(t):
    return A.asof_join(t.market.select("date"), ST.report_calendar(t.market), right_on="available").select("date", "kind", "fiscal")


STM = """(SELECT n_name AS symbol, last_day(date_trunc('quarter',CAST(o_orderdate AS DATE))+INTERVAL 2 MONTH) AS period, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100 AS revenue, count(*) AS orders_n,
 CASE WHEN any_value(n_nationkey)%2=0 THEN last_day(date_trunc('quarter',CAST(o_orderdate AS DATE))+INTERVAL 2 MONTH)+INTERVAL 30 DAY END AS filing
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2,date_trunc('quarter',CAST(o_orderdate AS DATE)))"""


def statements(t):
    period = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_nationkey", period.alias("period")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("revenue"), F.count(F.lit(1)).alias("orders_n"))
    g = g.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return g.select(F.col("n_name").alias("symbol"), "period", "revenue", "orders_n", F.when(F.col("n_nationkey") % 2 == 0, F.date_add("period", 30)).alias("filing"))


@query("fn16_filing_lag", fin("symbol period:t available:t", f"SELECT symbol, period, coalesce(filing, period+INTERVAL 45 DAY) AS available FROM {STM} WHERE coalesce(filing, period+INTERVAL 45 DAY)<=DATE '1999-06-30'"))
def _(t):
    return ST.available_rows(statements(t), F.lit("1999-06-30").cast("date")).select("symbol", "period", "available")


@query("fn17_resample_bars", fin("date symbol open high low close volume", f"SELECT max(date) AS date, symbol, arg_min(open,date) AS open, max(high) AS high, min(low) AS low, arg_max(close,date) AS close, sum(volume) AS volume FROM {BARS} GROUP BY symbol, {WEEKDAYS.format(d='date')}"))
def _(t):
    return P.resample_bars(t.bars, "W")


@query("fn18_bounded_math", fin("date a b c d", f"SELECT date, least(100,greatest(0,score*2-50)) AS a, tanh(score/50) AS b, 1/(1+exp(-least(20,greatest(-20,score-50)))) AS c, ln(p/(1-p)) AS d FROM (SELECT *, least(0.99,greatest(0.01,score/100)) AS p FROM {RISK})"))
def _(t):
    s = F.col("score")
    return t.risk.select("date", C.clip100(s * 2 - 50).alias("a"), F.tanh(s / 50).alias("b"), C.sigmoid(s - 50).alias("c"), C.logit(s / 100).alias("d"))


@query("fn19_safe_ratio", fin("id:i pct chg", "SELECT o_orderkey AS id, o_totalprice/nullif(o_orderkey%3,0)*100 AS pct, (o_totalprice-1000)/nullif(abs(o_orderkey%5-2.0),0)*100 AS chg FROM orders", 4))
def _(t):
    from tideframe.functions.scalar import ratio
    k = F.col("o_orderkey")
    r4 = lambda c: F.floor(c * 1e4 + 0.5) / 1e4
    return t.orders.select(k.alias("id"), r4(ratio("o_totalprice", k % 3) * 100).alias("pct"), r4(ratio(F.col("o_totalprice") - 1000, F.abs(k % 5 - 2)) * 100).alias("chg"))


@query("fn20_multi_branch_select", fin("date phase:s", f"SELECT date, CASE WHEN score>=70 THEN 'Crisis' WHEN score>=55 THEN 'Risk-Off' WHEN score>=40 THEN 'Warning' WHEN score>=25 THEN 'Fragile' ELSE 'Normal' END AS phase FROM {RISK}"))
def _(t):
    from tideframe.plans.risk_vector import phase
    return t.risk.select("date", phase("score").alias("phase"))


@query("fn21_half_open_bins", fin("date stage:s", f"SELECT date, CASE WHEN score/100<0.4 THEN 'Normal' WHEN score/100<0.55 THEN 'Watch' WHEN score/100<0.7 THEN 'De-risk' ELSE 'Cash' END AS stage FROM {RISK}"))
def _(t):
    from tideframe.operators.thresholds import stage_of
    return t.risk.select("date", stage_of(F.col("score") / 100, 0.4, 0.55, 0.7).alias("stage"))


@query("fn22_dominant_column", fin("date symbol dom:s", f"SELECT date, symbol, CASE WHEN greatest(open,high,low,close) IS NULL THEN 'none' WHEN open>=greatest(high,low,close) THEN 'open' WHEN high>=greatest(low,close) THEN 'high' WHEN low>=close THEN 'low' ELSE 'close' END AS dom FROM {BARS}"))
def _(t):
    from tideframe.plans.risk_vector import dominant
    return t.bars.select("date", "symbol", dominant(["open", "high", "low", "close"]).alias("dom"))


@query("fn23_vector_norm", fin("date symbol norm", f"SELECT date, symbol, sqrt(open*open+low*low+close*close)/sqrt(3.0) AS norm FROM {BARS}"))
def _(t):
    return t.bars.select("date", "symbol", (F.sqrt(F.col("open") * F.col("open") + F.col("low") * F.col("low") + F.col("close") * F.col("close")) / F.sqrt(F.lit(3.0))).alias("norm"))


@query("fn24_map_to_json", fin("date js:s", f"SELECT date, to_json(map_from_entries(list((driver, CAST(floor(level) AS BIGINT)) ORDER BY driver)))::VARCHAR AS js FROM {DRIVERS} GROUP BY date"))
def _(t):
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("driver", F.floor("level").cast("bigint")))))
    return t.drivers.groupBy("date").agg(F.to_json(m).alias("js"))


@query("fn25_payload_validity", fin("event_id:i ok:i k:i", """SELECT event_id, event_id%5<>0 AND event_id%5<>1 AS ok, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events"""))
def _(t):
    e = F.col("event_id") % 5
    body = F.when(e == 0, F.lit('{"Note": "call rate limit reached"}')).when(e == 1, F.lit("{}")).otherwise(F.col("props"))
    return t.events.select("event_id", X.usable_payload(body).alias("ok"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("fn26_account_mapping", fin("symbol period:t revenue orders_n", f"SELECT symbol, period, revenue, CAST(orders_n AS DOUBLE) AS orders_n FROM {STM}"))
def _(t):
    s = statements(t)
    rows = s.select("symbol", "period", F.posexplode(F.array(
        F.struct(F.lit("Total Revenue ").alias("account"), F.format_number("revenue", 2).alias("amount")),
        F.struct(F.lit("sales").alias("account"), F.lit("0").alias("amount")),
        F.struct(F.lit("ORDER COUNT").alias("account"), F.format_number("orders_n", 0).alias("amount")))).alias("pos", "r"))
    rows = rows.select("symbol", "period", "pos", "r.account", "r.amount")
    return ST.accounts_to_metrics(rows, {"revenue": ["totalrevenue", "sales"], "orders_n": ["ordercount"]}, ["symbol", "period"])


_YA = "coalesce(lag({c},4) OVER w, lag({c},1) OVER w)"


# Accounts of a statement: cents of the orders that count for them less cents of those that count against them,
# unknown in quarters whose number of orders is divisible by the last figure.
_ACCOUNTS = {
    "net_income": ("o_orderpriority<'2'", "o_orderpriority>='5'", 0), "gross_profit": ("o_orderpriority<'4'", "false", 9), "operating_income": ("o_orderpriority<'3'", "o_orderpriority>='5'", 0),
    "equity": ("o_orderstatus='F'", "o_orderstatus='P'", 0), "assets": ("o_orderpriority>='2'", "false", 0), "liabilities": ("o_orderstatus<>'F'", "false", 11),
    "cash": ("o_orderpriority>='3'", "o_orderpriority>='4'", 7), "operating_cashflow": ("o_orderpriority<'3'", "o_orderpriority>='4'", 5), "capex": ("false", "o_orderpriority>='5'", 3),
    "market_cap": ("o_orderstatus<>'P'", "false", 0)}
_FIGURES = ["return_on_equity", "return_on_assets", "debt_to_equity", "profit_margins", "operating_margins", "gross_margins", "free_cashflow", "revenue_growth", "earnings_growth", "net_cash_to_market_cap"]


def _account(plus, minus, unknown):
    cents = "CAST(round(o_totalprice*100) AS BIGINT)"
    value = f"CAST(sum(CASE WHEN {plus} THEN {cents} ELSE 0 END - CASE WHEN {minus} THEN {cents} ELSE 0 END) AS DOUBLE)/100"
    return f"CASE WHEN count(*)%{unknown}<>0 THEN {value} END" if unknown else value


ACCOUNTS = f"""(SELECT n_name AS symbol, last_day(date_trunc('quarter',CAST(o_orderdate AS DATE))+INTERVAL 2 MONTH) AS period, {_account("true", "false", 0)} AS revenue, {", ".join(f"{_account(*v)} AS {k}" for k, v in _ACCOUNTS.items())}
 FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1, 2)"""


@query("fn27_derived_fundamentals", fin("symbol period:t " + " ".join(_FIGURES), f"""SELECT symbol, period, net_income/nullif(equity,0) AS return_on_equity, net_income/nullif(assets,0) AS return_on_assets, liabilities/nullif(equity,0)*100 AS debt_to_equity,
 net_income/nullif(revenue,0) AS profit_margins, operating_income/nullif(revenue,0) AS operating_margins, gross_profit/nullif(revenue,0) AS gross_margins, operating_cashflow-abs(coalesce(capex,0)) AS free_cashflow,
 revenue/nullif({_YA.format(c='revenue')},0)-1 AS revenue_growth, net_income/nullif({_YA.format(c='net_income')},0)-1 AS earnings_growth, (coalesce(cash,0)-coalesce(liabilities,0))/nullif(market_cap,0)*100 AS net_cash_to_market_cap
 FROM {ACCOUNTS} WINDOW w AS (PARTITION BY symbol ORDER BY period)"""))
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_nationkey", F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("period")).agg(
        F.expr(_account("true", "false", 0)).alias("revenue"), *[F.expr(_account(*v)).alias(k) for k, v in _ACCOUNTS.items()])
    s = g.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "symbol")
    return ST.derived_fundamentals(ST.with_year_ago(s, ["revenue", "net_income"], order="period")).select("symbol", "period", *_FIGURES)


@query("fn28_year_ago_pairing", fin("symbol period:t revenue revenue_prior", f"SELECT symbol, period, revenue, {_YA.format(c='revenue')} AS revenue_prior FROM {STM} WINDOW w AS (PARTITION BY symbol ORDER BY period)"))
def _(t):
    return ST.with_year_ago(statements(t), ["revenue"], order="period").select("symbol", "period", "revenue", "revenue_prior")


_REGS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("fn29_one_hot", fin("date symbol " + " ".join(f"grp_{r.replace(' ', '_')}:i" for r in _REGS), "SELECT date, symbol, " + ", ".join(f"(grp='{r}')::INT AS grp_{r.replace(' ', '_')}" for r in _REGS) + f" FROM {WEEKLY}"))
def _(t):
    from tideframe.operators.learn import one_hot
    return one_hot(t.weekly, "grp", _REGS).select("date", "symbol", *[f"grp_{r.replace(' ', '_')}" for r in _REGS])


@query("fn30_interactions", fin("date symbol x_asia x_europe", f"SELECT date, symbol, (grp='ASIA')::INT*score AS x_asia, (grp='EUROPE')::INT*score AS x_europe FROM {WEEKLY}"))
def _(t):
    from tideframe.operators.learn import interactions, one_hot
    d = interactions(one_hot(t.weekly, "grp", _REGS), ["grp_ASIA", "grp_EUROPE"], ["score"])
    return d.select("date", "symbol", F.col("grp_ASIA_x_score").alias("x_asia"), F.col("grp_EUROPE_x_score").alias("x_europe"))


@query("fn31_regex_flags", fin("id:i metal:i paint:i", "SELECT p_partkey AS id, regexp_matches(p_name,'ring|bolt') AS metal, regexp_matches(p_type,'ECONOMY|PROMO') AS paint FROM part"))
def _(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").rlike("ring|bolt").alias("metal"), F.col("p_type").rlike("ECONOMY|PROMO").alias("paint"))


@query("fn32_state_to_number", fin("date ord:i budget", f"SELECT date, list_position(['Normal','Watch','De-risk','Cash'], st)-1 AS ord, CASE st WHEN 'Normal' THEN 1.0 WHEN 'Watch' THEN 0.75 WHEN 'De-risk' THEN 0.4 ELSE 0.1 END AS budget FROM (SELECT date, CASE WHEN score<40 THEN 'Normal' WHEN score<55 THEN 'Watch' WHEN score<70 THEN 'De-risk' ELSE 'Cash' END AS st FROM {RISK})"))
def _(t):
    from tideframe.operators.thresholds import STAGES, stage_of
    s = stage_of("score", 40, 55, 70)
    order = F.create_map(*[F.lit(x) for i, n in enumerate(STAGES) for x in (n, i)])
    budget = F.create_map(*[F.lit(x) for n, b in zip(STAGES, (1.0, 0.75, 0.4, 0.1)) for x in (n, b)])
    return t.risk.withColumn("st", s).select("date", order[F.col("st")].alias("ord"), budget[F.col("st")].alias("budget"))
