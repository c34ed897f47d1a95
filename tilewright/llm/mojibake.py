"""Text that was decoded with the wrong character encoding: detection and restoration."""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.seen import Seen
from tilewright.plans.lineage import cut, task_count

#: Encodings with one byte a character that texts are written in or wrongly decoded with.
SINGLE_BYTE = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac_roman", "cp437", "cp850", "iso8859-15", "cp1254", "cp852"]
#: Encodings with one or two bytes a character.
DOUBLE_BYTE = ["cp932", "euc_jp", "gbk", "big5", "euc_kr"]
#: Encodings that UTF-8 is wrongly decoded with twice in a row.
TWICE = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437"]
LOST = "�"
#: A word counts as the original of a garbled form if it is in at least so many times as many documents.
LEAST_RATIO = 4
TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
LETTERS = re.compile(r"[^\W_]+")
FOREIGN = re.compile(r"[\x80-\U0010ffff]+")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][0-9A-Za-z]{1,30});")
#: A token in which characters may be written as entities.
ESCAPED = re.compile(rf"(?:[0-9A-Za-z\x80-\U0010ffff]|{ENTITY.pattern})+")


CONTROLS = re.compile("[\x80-\x9f]")
_tables: dict[str, list[str]] = {}
_maps: dict[str, str] = {}
_inverse: dict[str, dict[str, int]] = {}


def _decoding(encoding: str) -> list[str]:
    """Character of each byte; bytes without one stand for the control character of that number."""
    out = _tables.get(encoding)
    if out is None:
        out = []
        for b in range(256):
            try:
                out.append(bytes([b]).decode(encoding))
            except UnicodeDecodeError:
                out.append(chr(b))
        _tables[encoding] = out
    return out


def _encoding(encoding: str) -> dict[str, int]:
    found = _inverse.get(encoding)
    if found is None:
        found = _inverse[encoding] = {c: b for b, c in reversed(list(enumerate(_decoding(encoding))))}
    return found


def _wrongly(data: bytes, encoding: str) -> str:
    table = _decoding(encoding)
    return "".join([table[b] for b in data])


def _back(text: str, encoding: str) -> str | None:
    """``text`` as UTF-8 that was decoded as ``encoding``; None if it can't be that."""
    table = _encoding(encoding)
    try:
        return bytes([table[c] for c in text]).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def undo_utf8(run: str) -> list[tuple[str, str]]:
    """(garbled piece, original character) pairs for a run of non-ASCII characters that is, as a whole, garbled UTF-8."""
    pairs: dict[tuple[str, str], None] = {}
    for last in SINGLE_BYTE:
        once = _back(run, last)
        if not once:
            continue
        for c in once:
            pairs[_wrongly(c.encode(), last), c] = None
        if last in TWICE and not once.isascii():
            for first in TWICE:
                twice = _back(once, first)
                for c in twice or "":
                    pairs[_wrongly(_wrongly(c.encode(), first).encode(), last), c] = None
    return [(g, c) for g, c in pairs if g != c]


def _is_mark(c: str) -> bool:
    """A character that texts are written with, not a control or the sign for lost ones."""
    return c > "\x7f" and c != LOST and unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs")


#: Signs that stand beside letters in ordinary text.
PUNCTUATION = set("“”‘’‚„«»‹›–—…¡¿·")
#: Signs that count as letters.
NO_LETTERS = set("ªºµ")


def _has_sign(run: str) -> bool:
    """Whether a run has a sign that words and sentences are not written with: its letters are hardly meant as they are."""
    return any((c in NO_LETTERS or unicodedata.category(c)[0] not in "LMZ") and c not in PUNCTUATION for c in run)


def garbled_characters(c: str) -> Iterator[str]:
    """Forms of a character whose UTF-8 was decoded wrongly once or twice, or that was lost in decoding."""
    for last in SINGLE_BYTE:
        once = _wrongly(c.encode(), last)
        yield once
        # bytes without a character may also have been dropped, or replaced
        kept = "".join(x for x in once if not "\x80" <= x <= "\x9f")
        if kept != once and len(kept) > 1:
            yield kept
    for first in TWICE:
        once = _wrongly(c.encode(), first).encode()
        for last in TWICE:
            yield _wrongly(once, last)
    yield LOST


def garbled_words(word: str) -> Iterator[tuple[str, str]]:
    """(form, chain) of a word that was written in one encoding and decoded with another."""
    for source in [*SINGLE_BYTE, *DOUBLE_BYTE]:
        try:
            data = word.encode(source)
        except UnicodeEncodeError:
            continue
        if source in SINGLE_BYTE:
            yield data.decode("utf-8", "replace"), f"{source}>utf-8"
        for target in SINGLE_BYTE:
            if target != source:
                form = _wrongly(data, target)
                yield form, f"{source}>{target}"
                yield "".join(x for x in form if not "\x80" <= x <= "\x9f"), f"{source}>{target}"
        for target in DOUBLE_BYTE:
            if target != source:
                yield data.decode(target, "replace"), f"{source}>{target}"
    data = word.encode()
    for target in DOUBLE_BYTE:
        yield data.decode(target, "replace"), f"utf-8>{target}"
    for target in SINGLE_BYTE:
        once = _wrongly(data, target)
        yield once, f"utf-8>{target}"
        yield "".join(x for x in once if not "\x80" <= x <= "\x9f"), f"utf-8>{target}"
        if target in TWICE:
            for last in TWICE:
                yield _wrongly(once.encode(), last), f"utf-8>{target}>utf-8>{last}"


_masks: dict[str, int] = {}


def _writable(c: str) -> int:
    """Which of the encodings can write a character, one bit each."""
    found = _masks.get(c)
    if found is None:
        found = 0
        for k, encoding in enumerate([*SINGLE_BYTE, *DOUBLE_BYTE]):
            try:
                c.encode(encoding)
                found |= 1 << k
            except UnicodeEncodeError:
                pass
        _masks[c] = found
    return found


def garbled_lists(words: list[str]) -> Iterator[tuple[str, list[int], list[str]]]:
    """(chain, numbers of words, their forms): ``garbled_words`` of many words, a chain at a time. Words have no line ends, so
    whole lists pass through the codecs as lines."""
    every = list(range(len(words)))
    masks = []
    for word in words:
        mask = -1
        for c in set(word):
            if c > "\x7f":
                mask &= _writable(c)
        masks.append(mask)

    def single(data: bytes, target: str) -> str:
        return codecs.charmap_decode(data, "strict", _maps.setdefault(target, "".join(_decoding(target))))[0]

    def double(some: list[int], data: bytes, target: str) -> list[str]:
        lines = data.decode(target, "replace").split("\n")
        return lines if len(lines) == len(some) else [part.decode(target, "replace") for part in data.split(b"\n")]

    def both(chain: str, some: list[int], text: str) -> Iterator[tuple[str, list[int], list[str]]]:
        yield chain, some, text.split("\n")
        kept = CONTROLS.sub("", text)
        if kept != text:
            yield chain, some, kept.split("\n")

    for k, source in enumerate([*SINGLE_BYTE, *DOUBLE_BYTE]):
        some = [i for i in every if masks[i] >> k & 1]
        if not some:
            continue
        data = "\n".join([words[i] for i in some]).encode(source)
        if source in SINGLE_BYTE:
            yield f"{source}>utf-8", some, data.decode("utf-8", "replace").split("\n")
        for target in SINGLE_BYTE:
            if target != source:
                yield from both(f"{source}>{target}", some, single(data, target))
        for target in DOUBLE_BYTE:
            if target != source:
                yield f"{source}>{target}", some, double(some, data, target)
    data = "\n".join(words).encode()
    for target in DOUBLE_BYTE:
        yield f"utf-8>{target}", every, double(every, data, target)
    for target in SINGLE_BYTE:
        once = single(data, target)
        yield from both(f"utf-8>{target}", every, once)
        if target in TWICE:
            for last in TWICE:
                yield f"utf-8>{target}>utf-8>{last}", every, single(once.encode(), last).split("\n")


def unescaped(text: str) -> str:
    """``text`` with the entities of non-ASCII characters replaced by these; others stay, as do names that mean nothing."""
    if "&" not in text:
        return text

    def one(match: re.Match) -> str:
        c = html.unescape(match.group())
        return match.group() if c == match.group() or c.isascii() else c

    return ENTITY.sub(one, text)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct tokens (t), non-ASCII characters (c) and garbled pieces (p) of every text that has a non-ASCII character, entities included.

    Pieces of a run that can be undone as a whole and has a sign come out as (s) too. ``copy`` is equal for equal texts.
    """
    runs: dict[str, list[str]] = {}
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, copy, text in zip(batch.column("row_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text")):
            text = unescaped(text.as_py() or "")
            if text.isascii():
                continue
            found: dict[tuple[str, str], None] = {}
            for token in set(TOKEN.findall(text)):
                if token.isascii():
                    continue
                found["t", token] = None
                for word in LETTERS.findall(token):
                    if not word.isascii():
                        found["t", word] = None
                for run in FOREIGN.findall(token):
                    found["t", run] = None
                    pieces = runs.get(run)
                    if pieces is None:
                        if len(runs) > 200_000:
                            runs.clear()
                        pieces = runs[run] = [g for g, _ in undo_utf8(run)]
                    sign = bool(pieces) and _has_sign(run)
                    for g in pieces:
                        found["p", g] = None
                        if sign:
                            found["s", g] = None
                    found["p", run] = None
            for c in set(text):
                if _is_mark(c):
                    found["c", c] = None
                elif c == LOST:
                    found["p", c] = None
            rows.extend((doc_id, copy, kind, token) for kind, token in found)
            if len(rows) > 100_000:
                yield _batch(rows, ["row_id", "copy", "kind", "token"])
                rows = []
        if rows:
            yield _batch(rows, ["row_id", "copy", "kind", "token"])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    numbers = {"row_id", "copy", "original_docs", "original_texts"}
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in numbers else pa.string()) for n, c in zip(names, zip(*rows))], names=names)


FORM_COLUMNS = ["kind", "form", "original", "chain", "original_docs", "original_texts"]


def _character_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Garbled forms of clean characters."""
    for batch in batches:
        rows: dict[tuple, None] = {}
        for token, docs, texts in zip(*(batch.column(c).to_pylist() for c in ("token", "docs", "texts"))):
            for form in garbled_characters(token):
                if form != token:
                    rows["p", form, token, "utf-8", docs, texts] = None
                    rows["s", form, token, "utf-8", docs, texts] = None
        if rows:
            yield _batch(list(rows), FORM_COLUMNS)


def _word_forms(seen, characters: set[str]) -> Callable:
    """Garbled forms of clean words that may occur: the others would find no partner in the join."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = seen.value

        def may_occur(form: str) -> list[str]:
            if not characters.issuperset(form) or form.isascii() or not form.strip(LOST):
                return []
            # bytes of a double-byte character may be ASCII and end a token; long parts stand for the whole
            parts = [form] if TOKEN.fullmatch(form) else [r for r in FOREIGN.findall(form) if len(r) > 3]
            return [p for p in parts if held.may_have(p)]

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                clean = [r for r in zip(*(batch.column(c).slice(lo, 512).to_pylist() for c in ("token", "docs", "texts"))) if all(c < "\x80" or _is_mark(c) for c in r[0])]
                if not clean:
                    continue
                rows: dict[tuple, None] = {}
                known: dict[str, list[str]] = {}  # many chains give the same form
                for chain, numbers, lines in garbled_lists([r[0] for r in clean]):
                    for i, form in zip(numbers, lines):
                        parts = known.get(form)
                        if parts is None:
                            parts = known[form] = may_occur(form)
                        for part in parts:
                            if form != clean[i][0]:
                                rows["t", part, clean[i][0], chain, *clean[i][1:]] = None
                if rows:
                    yield _batch(list(rows), FORM_COLUMNS)

    return forms


#: Words that a task of the form table takes: each has some 150 forms.
WORDS_A_TASK = 2_000


def _evidence(documents: DataFrame, least_ratio: int) -> DataFrame:
    """(doc_id, lone, kind, form, original, chain, sure) of the confirmed garbled forms in documents."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("row_id"), F.col("text").cast("string").alias("text")).withColumn("copy", F.xxhash64("text"))
    tokens = cut(rows.mapInArrow(_tokens, "row_id bigint, copy bigint, kind string, token string"), "tokens")
    counts = cut(tokens.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("docs"), F.count_distinct("copy").alias("texts")), "counts")
    words = counts.where("kind = 't'")
    distinct = words.count()
    seen = spark.sparkContext.broadcast(Seen.of(words.select(F.xxhash64("token").alias("h")), distinct))
    # the characters of all tokens; there are no more than Unicode has
    used = words.select(F.explode(F.array_distinct(F.split("token", ""))).alias("c")).distinct()
    characters = {r["c"] for r in used.toLocalIterator()} | set(map(chr, range(128)))
    schema = "kind string, form string, original string, chain string, original_docs bigint, original_texts bigint"
    forms = counts.where("kind = 'c'").mapInArrow(_character_forms, schema).unionByName(words.repartition(task_count(spark, distinct, WORDS_A_TASK), "token").mapInArrow(_word_forms(seen, characters), schema))
    found = counts.where("kind in ('t', 'p', 's')").withColumnRenamed("token", "form")
    utf8 = F.col("chain").startswith("utf-8")
    ratio = F.when((F.col("kind") == "t") & ~utf8, least_ratio).otherwise(1)
    # a garbled text that is copied often outnumbers its originals by documents, but not by distinct texts
    enough = (F.col("original_docs") >= F.col("docs") * ratio) | (F.col("original_texts") >= F.col("texts") * ratio)
    # nor may copies of a garbled text make its forms the originals of the words
    enough = enough & ((F.col("kind") != "t") | (F.col("original_texts") >= F.col("texts")))
    # a rarer word is still some evidence, if it is in more texts than its form, and the form is more than a letter
    foreign = F.length(F.regexp_replace("form", r"[\x00-\x7f]", ""))
    some = (F.col("kind") == "t") & (F.col("original_texts") > F.col("texts")) & ((foreign > 1) | (F.length("form") > 2))
    sure = enough | (F.col("kind") == "s") | (F.col("form") == LOST)
    confirmed = forms.join(found, ["kind", "form"]).where(sure | some).withColumn("sure", sure)
    # of several originals of a form under one chain the surest, the most frequent, then the smallest
    best = confirmed.groupBy("kind", "form", "chain").agg(F.min(F.struct((~F.col("sure")).alias("unsure"), (-F.col("original_docs")).alias("n"), "original")).alias("best"), (F.min("original") == F.max("original")).alias("one"))
    # a form with lost characters that several words fit proves the damage, but stays as it is
    best = best.select("kind", "form", "chain", (~F.col("best.unsure")).alias("sure"), F.when(F.col("one") | ~F.col("form").contains(LOST), F.col("best.original")).otherwise(F.col("form")).alias("original"))
    # documents without an id are told apart by their text
    lone = F.when(F.col("row_id").isNull(), F.col("copy")).otherwise(0)
    return tokens.select(F.col("row_id").alias("doc_id"), lone.alias("lone"), "kind", F.col("token").alias("form")).join(best, ["kind", "form"])


def garbled_documents(documents: DataFrame, *, least_ratio: int = LEAST_RATIO) -> DataFrame:
    """(doc_id, pairs) of the documents with garbled text; ``pairs`` are (form, original, kind) to substitute.

    ``documents``: ``doc_id`` bigint, ``text``. Null and empty texts are clean, ASCII texts too unless entities (``&Atilde;``) stand
    for other characters, which are read as these. One row per doc_id; rows that share one are judged together, those without
    one by their text. Other columns are ignored.

    The forms that every distinct word and character would take under all chains of encodings are a table; of the forms of words only those
    that a map of all tokens may hold are kept (the join drops the others anyway). Documents' tokens are joined to it by hash.
    A word proves a form of a one-byte encoding if it is in ``least_ratio`` times as many documents, which keeps foreign words
    that are meant; one in more distinct texts than the form counts for half. Garbled UTF-8 is matched by word, which must be in as
    many documents, and, since names and rare words have no clean twin, by character too, which must occur clean: in any document,
    where the run that is undone has a sign that words
    are not written with; else in as many documents as the form, since words can look like UTF-8 by chance ("так" in
    cp866). All of these comparisons hold if they do by documents or by distinct texts, so copies can't outnumber
    originals; a word must be in at least as many distinct texts as its form. Forms of one-byte encodings count as proof only
    together: two words of two foreign characters, or of one among three characters, under one chain, or one word of three.
    """
    foreign = F.length(F.regexp_replace("form", r"[\x00-\x7f]", ""))
    alone = F.when(foreign >= 3, 4).when((foreign == 2) | (F.length("form") >= 3), 2).otherwise(0)
    alone = F.when(F.col("sure"), alone).otherwise((alone / 2).cast("int"))
    certain = F.col("kind").isin("p", "s") | (F.col("sure") & F.col("form").contains(LOST)) | (F.col("sure") & F.col("chain").startswith("utf-8") & (foreign >= 3))
    strength = F.when(certain, 9).otherwise(alone)
    found = _evidence(documents, least_ratio).withColumn("strength", strength)
    by_chain = found.groupBy("doc_id", "lone", "chain").agg(F.collect_set(F.struct("form", "original", "kind", "strength")).alias("pairs"))
    proven = by_chain.where(F.aggregate("pairs", F.lit(0), lambda n, p: n + p["strength"]) >= 4)
    return proven.groupBy("doc_id", "lone").agg(F.flatten(F.collect_list(F.transform("pairs", lambda p: F.struct(p["form"].alias("form"), p["original"].alias("original"), p["kind"].alias("kind"))))).alias("pairs")).drop("lone")


def _undone(run: str, pieces: set[str]) -> str | None:
    """``run`` with its garbled UTF-8 undone, all of whose pieces must be known."""
    best = None
    for last in SINGLE_BYTE:
        once = _back(run, last)
        if not once:
            continue
        if all(c < "\x80" or _wrongly(c.encode(), last) in pieces for c in once):
            best = best or once
        if last in TWICE and not once.isascii():
            for first in TWICE:
                twice = _back(once, first)
                if twice and all(c < "\x80" or _wrongly(_wrongly(c.encode(), first).encode(), last) in pieces for c in twice):
                    return twice
    return best


def restore(text: str, pairs: list[dict]) -> str:
    """``text`` with the garbled forms of ``pairs`` replaced by their originals. Entities stay where nothing is garbled."""
    pieces = {p["form"]: p["original"] for p in pairs if p["kind"] in "ps" and p["form"] != LOST}
    words = {p["form"]: p["original"] for p in pairs if p["kind"] == "t"}
    known = set(pieces)

    def foreign(match: re.Match) -> str:
        run = match.group()
        return _undone(run, known) or pieces.get(run) or words.get(run) or run

    def mended(token: str) -> str:
        out = FOREIGN.sub(foreign, token)
        if out != token:
            return out
        return words.get(token) or LETTERS.sub(lambda w: words.get(w.group(), w.group()), token)

    def token(match: re.Match) -> str:
        whole = match.group()
        plain = unescaped(whole)
        if plain.isascii():
            return whole
        out = TOKEN.sub(lambda m: m.group() if m.group().isascii() else mended(m.group()), plain)
        return whole if out == plain else out

    return ESCAPED.sub(token, text)


def restored_documents(documents: DataFrame, *, least_ratio: int = LEAST_RATIO) -> DataFrame:
    """(doc_id, text, restored) of the garbled documents: ``restored`` has each proven form's original in its place.

    What was lost is restored only where one clean word fits. Rows that share a doc_id each come out.
    """
    known = garbled_documents(documents, least_ratio=least_ratio)
    both = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(known, "doc_id")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pairs = batch.column("text"), batch.column("pairs").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, pa.array([restore(t.as_py(), p) for t, p in zip(texts, pairs)], pa.string())], names=["doc_id", "text", "restored"])

    return both.mapInArrow(mend, "doc_id bigint, text string, restored string")
