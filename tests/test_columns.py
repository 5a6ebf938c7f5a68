"""Edge rows of the column functions."""

from datetime import datetime

from pyspark.sql import functions as F

from siftline.functions import html as H, messages as M, text as TX, urls as U
from siftline.operators import tactics as TC


def values(spark, inputs, column):
    """Column results for a list of one-column inputs, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_domain_and_host(spark):
    urls = ["https://WWW.Ex.be:8080/x", "Ex.be", "", None, "http://user@host.com/p", "http://[::1]:80/", "x?u=http://a", " www.A.com "]
    assert values(spark, urls, U.domain_key) == ["ex.be:8080", "ex.be", "", "", "user@host.com", "[::1]:80", "", "a.com"]
    assert values(spark, urls, U.host_key) == ["ex.be", "", "", "", "host.com", "::1", "", ""]
    assert values(spark, ["https://www.B.com/a", "bare.com"], U.netloc_key) == ["b.com", ""]


def test_root_and_search_pages(spark):
    base = "https://a.be"
    rows = ["", "/", "/nl", "/abc", "/abcd", "/nl-be", "/nl-be/", "/nl?x=1", "/nl/x", "/?q", "//"]
    got = values(spark, [base + r for r in rows], U.is_root_page)
    assert got == [True, True, True, True, False, True, True, False, False, False, True]
    rows = ["?a=1", "?a", "/zoeken/x", "/Search", "/find-me", "/vakantie", "/vakantie/", "/p#?a=1"]
    assert values(spark, [base + r for r in rows], U.is_search_page) == [True, False, True, True, True, False, True, False]


def test_param_names(spark):
    queries = ["a=1&b=&&c&a=2", "", "x%5B0%5D=1&y+z=2", "100%=1&%zz=2&%41=3", "=5&q"]
    got = values(spark, queries, U.param_names)
    assert got == [["a", "b", "c"], [], ["x[0]", "y z"], ["100%", "%zz", "A"], ["", "q"]]


def test_search_template_drops_values_fragment_and_params(spark):
    def template(c):
        return U.search_template(c, U.param_names(U.url_query(c)))

    many = "&".join(f"p{i}={i}" for i in range(20))
    got = values(spark, ["HTTPS://A.be/s;v=1?q=2&r=#f", "http://a.be", f"http://a.be/s?{many}"], template)
    assert got[:2] == ["https://A.be/s?q=…&r=…", "http://a.be/"]
    assert got[2].count("=…") == 15


def test_suffixes(spark):
    assert values(spark, ["a.b.c", "x"], U.host_suffixes) == [["a.b.c", "b.c", "c"], ["x"]]


def test_price_number(spark):
    prices = ["€ 1.299", "1 299", "12.", "op aanvraag", None, "49,50 EUR", "0"]
    assert values(spark, prices, TX.price_number) == [1.299, 1299.0, 12.0, None, None, 49.5, 0.0]


def test_price_hints(spark):
    nbsp, line_separator = chr(0xA0), chr(0x2028)
    lines = [f"1.299{nbsp}€", "DÈS 12", "€ 5", "€ 55", "€" + " " * 2 + "1", "dès 12", "x" * 175 + " € 12", "x" * 176 + " € 12", "nothing"]
    got = values(spark, ["\n".join(lines), "\r\n".join(f"€ {i}0" for i in range(20)), None, f"€ 10\x1c€ 20{line_separator}€ 30"], TX.price_hints)
    assert got[0] == [f"1.299{nbsp}€", "DÈS 12", "€ 55", "x" * 175 + " € 12"]
    assert len(got[1]) == 15 and got[1][0] == "€ 00"
    assert got[2] == []
    assert got[3] == ["€ 10", "€ 20", "€ 30"]


def test_name_key(spark):
    names = ["Spain Palace", "Hotel Spa", "Suites", "The Grand-Hôtel", None, "Adults Only Club 7"]
    assert values(spark, names, TX.name_key) == ["inpalace", "", "", "grandhtel", "", "7"]


def test_visible_text_and_trim(spark):
    raw = "  a \r\n\r\n\tb   c\x0b d\x1de" + chr(0x2028) + "f  "
    assert values(spark, [raw], TX.visible_text) == ["a\nb   c\nd\ne\nf"]
    assert values(spark, [" x\t"], TX.utrim) == ["x"]


def test_truncation(spark):
    text = "é" * 30
    got = values(spark, [text, "é" * 10], lambda c: TX.cut_page(c, 10))
    assert got == ["é" * 10 + "\n\n...[truncated at 10 chars]", "é" * 10]
    assert values(spark, [text], lambda c: TX.cut_body(c, F.lit(10)))[0].startswith("é" * 10 + "\n...[truncated 30 -> 10 chars; ")
    assert values(spark, [text], lambda c: TX.cut_other(c, 10)) == ["é" * 10 + "...[truncated 30 chars]"]


def test_search_query(spark):
    long = "one two three four five six seven eight?"
    wide = " ".join(["w" * 11] * 12)
    got = values(spark, ["  hotel crete ", long, " ", wide, " ".join("abcdefghijklmn"), "it's " * 13], TX.search_query)
    assert (got[0]["query"], got[0]["warning"]) == ("hotel crete", None)
    assert got[1]["query"] == long and "(8 words, 40 chars)" in got[1]["warning"] and got[1]["warning"].endswith(f"Used: '{long}'")
    assert (got[2]["query"], got[2]["warning"]) == ("", "empty query")
    assert got[3]["query"] == " ".join(["w" * 11] * 10)
    assert got[4]["query"] == "a b c d e f g h i j k l"
    assert got[5]["warning"].endswith('Used: "' + " ".join(["it's"] * 12) + '"')


def test_clean_list_json(spark):
    got = values(spark, ['[" a ", "", "b"]', '" x "', "null", "5", None, '{"a":1}'], TX.clean_list_json)
    assert got == [["a", "b"], ["x"], [], [], [], []]


def test_html(spark):
    page = (
        "<html><head><title> A &amp; B </title><style>p{}</style></head><body><HEADER>menu</HEADER>"
        '<script>var t="</p>";</script><p>one<b>two</b>&nbsp;<!-- <p>no</p> --> three &lt;4&gt;</p><nav>x</nav></body></html>'
    )
    assert values(spark, [page], H.page_title) == ["A & B"]
    assert values(spark, [page], H.page_text) == ["A & B\none\ntwo\nthree <4>"]


def test_plan_steps(spark):
    raws = ['```json\n["a", " b "]\n```', 'Sure: ["x", 1, ""] ok', "no list", '["a", oops]', '["1","2","3","4"]', None, "[]"]
    got = values(spark, raws, lambda c: M.plan_steps(c, F.lit("task")))
    assert got == [["a", "b"], ["x", "1"], ["task"], ["task"], ["1", "2", "3"], ["task"], ["task"]]


def test_tool_calls(spark):
    text = '{"role":"assistant","tool_calls":[{"function":{"name":"a","arguments":"{\\"u\\":1}"}},{"function":{"arguments":"oops"}}]}'
    df = spark.createDataFrame([(1, text), (2, '{"role":"user","content":"x"}')], "i int, t string")
    rows = M.tool_calls(df.select("i", F.from_json("t", M.MESSAGE_TYPE).alias("message"))).orderBy("call_no").collect()
    assert [(r.i, r.call_no, r.tool, r.arguments) for r in rows] == [(1, 0, "a", {"u": "1"}), (1, 1, "", {})]


def test_disposition(spark):
    df = spark.createDataFrame([(1, "x"), (0, "research_complete"), (0, "y" * 501), (0, "y" * 500), (0, None)], "n int, c string")
    got = [r[0] for r in df.select(M.disposition(F.col("n"), F.col("c"))).collect()]
    assert got == ["tool_calls", "complete", "nudge", "continue", "continue"]


def test_run_slug(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2, 3, 4, 5), "Été 2024/plan!" + "x" * 40)], "t timestamp_ntz, s string")
    assert df.select(TX.run_slug(F.col("t"), F.col("s"))).first()[0] == "2024-01-02T03-04-05_Été_2024_plan_" + "x" * 26


def test_staleness(spark):
    rows = [("2024-01-01T00:00:00+00:00",), ("2024-03-01T00:00:00Z",), ("soon",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    as_of = F.lit("2024-03-15 00:00:00").cast("timestamp")
    assert [r[0] for r in df.select(TC.is_stale(TC.parse_verified(F.col("v")), as_of)).collect()] == [True, False, False, False]


def test_spaces_are_no_line_breaks(spark):
    assert values(spark, ["a b" + chr(0xA0) + "c"], TX.visible_text) == ["a b" + chr(0xA0) + "c"]
    assert values(spark, [chr(0xA0) + " x" + chr(0x2003)], TX.utrim) == ["x"]
