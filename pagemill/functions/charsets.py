"""The charsets that a page's bytes may be in, as expressions over binary columns.

The order is that of a browser: a byte order mark settles it; else the
declaration in the first bytes (an XML prolog or a ``meta`` element); else
what the bytes themselves allow: ISO-2022-JP by its escapes, UTF-8 if the whole
body is valid, EUC-JP or Shift_JIS if kana pairs make a fifth of all other
bytes than ASCII, and last the Western code page. The parse decodes by the
first of them that takes every byte; a page that none takes fails alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes in which a declaration is looked for.
PRESCAN = 4096
#: Byte order marks, longer ones first, and the codecs that read them.
MARKS = [("fffe0000", "utf-32"), ("0000feff", "utf-32"), ("efbbbf", "utf-8-sig"), ("fffe", "utf-16"), ("feff", "utf-16")]
#: Declared names that stand for another code page than their own (fixed values of the web's encoding standard).
LABELS = {"shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "ms_kanji": "cp932",
          "windows-31j": "cp932", "iso-8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "ascii": "cp1252",
          "us-ascii": "cp1252", "x-cp1252": "cp1252", "windows-1252": "cp1252", "x-euc-jp": "euc_jp", "euc-jp": "euc_jp",
          "csiso2022jp": "iso2022_jp", "iso-2022-jp": "iso2022_jp", "gb2312": "gb18030", "gbk": "gb18030",
          "x-gbk": "gb18030", "big5-hkscs": "big5hkscs", "euc-kr": "cp949", "ks_c_5601-1987": "cp949",
          "iso-8859-9": "cp1254", "utf8": "utf-8", "utf-16": "utf-8", "utf-16le": "utf-8", "utf-16be": "utf-8"}
WESTERN = "cp1252"
NAME = "([A-Za-z0-9._:-]+)"
XML = "^\\s*<\\?xml[^>]*?encoding\\s*=\\s*[\"']" + NAME
META = "(?i)<meta[^>]+?charset\\s*=\\s*[\"']?\\s*" + NAME
KANA_EUC = "\\xA4[\\xA1-\\xF3]|\\xA5[\\xA1-\\xF6]"
KANA_SJIS = "\\x82[\\x9F-\\xF1]|\\x83[\\x40-\\x96]"


def marked(body: Column) -> Column:
    """The codec of the body's byte order mark, or null."""
    head = F.lower(F.hex(F.substring(body, 1, 4)))
    out = F.when(F.startswith(head, F.lit(MARKS[0][0])), MARKS[0][1])
    for mark, codec in MARKS[1:]:
        out = out.when(F.startswith(head, F.lit(mark)), codec)
    return out


def declared(body: Column) -> Column:
    """The codec that the first bytes declare, or null."""
    head = F.decode(F.substring(body, 1, PRESCAN), "ISO-8859-1")
    label = F.lower(F.coalesce(F.nullif(F.regexp_extract(head, XML, 1), F.lit("")),
                               F.nullif(F.regexp_extract(head, META, 1), F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(known[label], label)


def _kana(body: Column, pattern: str) -> Column:
    """Whether kana pairs of a code make a fifth of the bytes above ASCII, which have to be there."""
    text = F.decode(body, "ISO-8859-1")
    high = F.regexp_count(text, F.lit("[\\x80-\\xFF]"))
    return (high > 0) & (10 * F.regexp_count(text, F.lit(pattern)) >= high)


def charsets(body: Column) -> Column:
    """The codecs to try on a body, in their order: an array."""
    escapes = F.contains(body, F.unhex(F.lit("1B2442"))) | F.contains(body, F.unhex(F.lit("1B2440")))
    valid = F.is_valid_utf8(body.cast("string"))
    guess = (F.when(escapes, "iso2022_jp").when(valid, "utf-8")
              .when(_kana(body, KANA_EUC), "euc_jp").when(_kana(body, KANA_SJIS), "cp932"))
    mark = marked(body)
    return F.when(mark.isNotNull(), F.array(mark)).otherwise(
        F.array_distinct(F.array_compact(F.array(declared(body), guess, F.lit("utf-8"), F.lit(WESTERN)))))
