"""All words of the given pages, read by another parser without a tree or layout."""

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import functions as F

from gridtempo.llm import queries

UNSEEN = {"script", "style", "title", "template", "noscript", "iframe"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())


class Words(HTMLParser):
    """Text outside unseen and hidden elements; a hidden element ends with its own end tag at its own depth."""

    def __init__(self):
        super().__init__()
        self.hidden: list[str] = []
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        told = dict(attrs)
        unseen = tag in UNSEEN or "hidden" in told or re.search(r"display\s*:\s*none", told.get("style") or "", re.I)
        if tag not in VOID and (self.hidden and tag == self.hidden[0] or unseen):
            self.hidden.append(tag)
        self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        self.text.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def letters(text):
    return Counter(re.findall(r"[^\W\d_]+", text))


def test_given_pages_keep_all_their_words(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op4_layout_text(spark, sf_dir).select("page_id", F.col("text")).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    inline = re.compile(r"</?(?:a|b|i|em|strong|code|span|u|tt|small|big|font|s)\b[^>]*>", re.I)
    for r in got:
        parser = Words()
        parser.feed(inline.sub("", pages[r.page_id] or ""))
        parser.close()
        want, found = letters("".join(parser.text)), letters(r.text)
        assert want == found, (r.page_id, want - found, found - want)
