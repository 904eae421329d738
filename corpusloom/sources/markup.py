"""Column expressions over marked-up texts: pages of tags, question-and-answer Markdown, decoded bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are never shown, tags that begin a new line, labels of what was asked and answered.
HIDDEN = ("script", "style")
LINE_TAGS = ("br", "div", "p", "section", "h1", "h2", "h3", "h4", "h5", "h6")
ASKED = ("q", "question", "user")
ANSWERED = ("a", "answer", "ai", "assistant", "perplexity")
HIDDEN_ELEMENT = "(?is)" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in HIDDEN)


def labelled(labels: tuple[str, ...]) -> str:
    """The pattern of a bold label, with a colon or the end of the bold print behind it."""
    return rf"\*\*(?i:{'|'.join(labels)})[:*]"


def strip_html(html: Column) -> Column:
    """Text of an HTML page, cut up at its tags: hidden elements are dropped, line tags begin a new line, and of the empty lines in a row
    one is left. A ``<`` that opens no tag stays. Null stays null."""
    def shown(piece: Column) -> Column:
        end = F.instr(piece, ">")
        name = F.regexp_extract(F.lower(piece), "^/?([a-z0-9]+)", 1)
        return F.when(end <= 1, F.concat(F.lit("<"), piece)).otherwise(F.concat(F.when(name.isin(*LINE_TAGS), "\n").otherwise(""), F.substr(piece, end + 1)))

    cut = F.split(F.regexp_replace(html, HIDDEN_ELEMENT, ""), "<")
    text = F.array_join(F.concat(F.slice(cut, 1, 1), F.transform(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))), shown)), "")
    return F.btrim(F.regexp_replace(text, r"\n\n\n+", "\n\n"), F.lit(" \t\r\n"))


def question_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(labelled(ASKED))).cast("long")


def answer_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(labelled(ANSWERED))).cast("long")


def cited_links(text: Column, most: int | None = None) -> Column:
    """All links of a text in order, the first ``most`` if given."""
    links = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://\S+"), F.lit(0))
    return links if most is None else F.slice(links, 1, most)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 if they are valid UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
