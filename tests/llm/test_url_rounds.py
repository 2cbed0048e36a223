"""Scores follow links as far as they stay above the threshold."""

from marlstone.llm import url_graph


def test_chain_of_twelve_hosts(spark, scratch):
    # host i links to host i + 1; the last one is blocked, and distrust goes backwards
    rows = [(i, f"http://h{i}.net/x", f'<a href="http://h{i + 1}.net/x">') for i in range(12)] + [(12, "http://h12.net/bad/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = (url_graph.PathRule("h12.net/bad/", False),)
    got = {r["page_id"]: r["verdict"] for r in url_graph.judge(pages, scratch, rules).collect()}
    assert set(got.values()) == {"block"} and len(got) == 13
