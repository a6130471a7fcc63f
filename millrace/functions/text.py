"""Column functions of text analysis and keyword scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no weight, the parameters of the keyword score, and the constant of rank fusion.
STOPWORDS = "a an and are as at be by for from has in is it its of on or that the this to was were will with".split()
K1, B, RRF = 1.2, 0.75, 60

# Han, Hiragana and Katakana all lie past U+2E7F: testing the range first spares the other characters a search for their script.
_CJK = r"[\x{2E80}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"
_WORD = r"[0-9a-zß-öø-ÿ[\p{L}\p{Nd}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]]"
_TOKEN = f"({_WORD}+|{_CJK})"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, one token per CJK character; single letters and stopwords are dropped."""
    found = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 1)
    return F.filter(found, lambda x: ((F.char_length(x) > 1) & ~x.isin(STOPWORDS)) | x.rlike(f"^{_CJK}$"))


def indexed_text(heading: Column, text: Column) -> Column:
    return F.concat_ws(" ", heading, text)


def inverse_document_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_score(n: Column, df: Column, tf: Column, length: Column, average: Column) -> Column:
    mean = F.when(average > 0, average).otherwise(1.0)
    return inverse_document_frequency(n, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def token_estimate(text: Column) -> Column:
    """The larger of a quarter of the characters and four thirds of the words, both rounded up."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.greatest(F.floor((F.char_length(text) + 3) / 4), F.floor((words * 4 + 2) / 3)).cast("long")


def paragraphs(text: Column) -> Column:
    """Parts that each keep the blank line they end in, so that together they are the text."""
    return F.filter(F.split(text, r"(?<=\n\n)"), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?]\s)|(?<=\n)"), lambda x: x != "")


def normal_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, max_tokens: int) -> Column:
    return F.substring(text, 1, 3 * max_tokens)


def trimmed(text: Column, most: int) -> Column:
    """At most `most` characters, cut at the last blank if that lies past the middle, and an ellipsis where cut."""
    head = F.substring(text, 1, most)
    before = F.regexp_extract(head, r"(?s)^(.*)[ \n]", 1)
    cut = F.when(F.octet_length(before) > most // 2, before).otherwise(head)
    return F.when(F.char_length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text) if most >= 0 else text


def clean_markdown(text: Column) -> Column:
    """Images become their alternative text, reference definitions go, blank lines are at most one."""
    out = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"<img [^>]*alt=\"([^\"]*)\"[^>]*>", "$1")
    out = F.regexp_replace(out, r"(?m)^\[[^\]]+\]:[^\n]*$", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_page(text: Column) -> Column:
    """Page text without controls; the soft hyphen mark U+0002 is a hyphen."""
    return F.trim(F.regexp_replace(F.translate(text, "\x02", "-"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def clock(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, seconds)).when(ms.isNotNull(), F.format_string("%d:%02d", minutes, seconds))


def search_glob(pattern: str) -> str:
    """Regular expression of a search glob: * and ? cross folders, [..] and [^..] are classes, case counts."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c.isascii() else c
        i += 1
    return f"(?s)^{out}$"


def ignore_glob(pattern: str) -> str:
    """Regular expression of an ignore glob: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c.isascii() else c
            i += 1
    return f"^{out}$"
