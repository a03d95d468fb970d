"""Text measures and clean-up as column expressions, so that they stay in the JVM and in one stage."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .scoring import nfc

#: Unicode ranges of the target languages.
LANGUAGE_RANGES = {
    "my": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "lo": ((0x0E80, 0x0EFF),),
    "km": ((0x1780, 0x17FF), (0x19E0, 0x19FF)),
}


def char_class(ranges) -> str:
    """Inside of a regular expression's character class for (first, last) code points."""
    return "".join(rf"\x{{{a:04X}}}-\x{{{b:04X}}}" for a, b in ranges)


#: Letters by script.
SCRIPTS = {"latin": r"\p{IsLatin}"} | {k: rf"[{char_class(r)}&&\p{{L}}]" for k, r in LANGUAGE_RANGES.items()}


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_transcript(text: Column) -> Column:
    """NFC, white space runs to one blank, trimmed."""
    return collapse_space(nfc(text))


def letters_of(text: Column) -> Column:
    """Letters, marks and numbers alone."""
    return F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", "")


#: Latin letters that most texts are made of: a plain list of ranges is matched faster than categories and scripts, which only what's left is asked for.
COMMON_LETTERS = r"[A-Za-z\x{AA}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2B8}]+"


def _less_common(text: Column) -> Column:
    return F.regexp_replace(text, COMMON_LETTERS, "")


def script_metrics(text: Column) -> Column:
    """Letters by script, and the share of Latin among all letters (0 without letters)."""
    rest = _less_common(text)
    common = F.length(text) - F.length(rest)
    count = lambda p: F.length(rest) - F.length(F.regexp_replace(rest, f"{p}+", ""))
    n = common + count(r"\p{L}")
    counts = {k: common + count(p) if k == "latin" else count(p) for k, p in SCRIPTS.items()}
    return F.struct(n.alias("letters"), *(c.alias(k) for k, c in counts.items()), (counts["latin"] / F.greatest(n, F.lit(1))).alias("latin_ratio"))


def lower(text: Column) -> Column:
    """Lower case by code point alone, so that İ is one letter and a Σ is the same at a word's end as elsewhere."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def max_token_run(text: Column, space: str = r"(?U)\s") -> Column:
    """Longest run of equal lower-case tokens between runs of ``space``; 0 without a token."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, token: Column) -> Column:
        run = F.when(token == acc["last"], acc["run"] + 1).otherwise(1)
        return F.struct(token.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    tokens = F.filter(F.split(lower(text), f"{space}+"), lambda t: t != "")
    return F.aggregate(tokens, start, step)["best"]


def _most_fourgrams(texts: pd.Series) -> pd.Series:
    """Per text, the greatest count of one run of four code points: one sort of (text, gram) numbers for some texts at a time."""
    out = np.zeros(len(texts), np.int32)
    if not texts.notna().any():
        return pd.Series(out)
    n = texts.str.len().to_numpy(np.int64, na_value=0)
    ends = np.cumsum(n)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 500_000, "right")))
        points = np.frombuffer("".join(texts.iloc[at:to].fillna("")).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.repeat(np.arange(to - at), n[at:to])
        if len(points) > 3:
            _, name = np.unique(points, return_inverse=True)
            name = name.astype(np.uint64)
            width = np.uint64(int(name.max()) + 1)
            pair = name[:-1] * width + name[1:]
            _, pair = np.unique(pair, return_inverse=True)
            gram = pair[:-2].astype(np.uint64) * np.uint64(int(pair.max()) + 1) + pair[2:].astype(np.uint64)
            _, gram = np.unique(gram, return_inverse=True)
            inside = own[3:] == own[:-3]
            key = np.sort(own[:-3][inside] * (int(gram.max()) + 1) + gram[inside])
            if len(key):
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                np.maximum.at(out, at + key[first] // (int(gram.max()) + 1), np.diff(np.append(first, len(key))).astype(np.int32))
        at = to
    return pd.Series(out)


def max_fourgram(text: Column) -> Column:
    """Most occurrences of one 4-code-point gram of letters, marks and numbers. Short texts can't repeat one and skip the helper."""
    compact = letters_of(text)
    return F.when(F.length(compact) < 4, 0).when(F.length(compact) == 4, 1).otherwise(F.pandas_udf(_most_fourgrams, IntegerType())(compact))


def many_fourgrams(text: Column, most: int) -> Column:
    """Whether ``max_fourgram`` is over ``most``.

    Of more than ``most`` places among n - 3, two are at most (n - 4) / ``most`` from each other. Only texts with a gram that stands again so near go to the helper.
    """
    compact, n = letters_of(text), F.length(text)  # n is no less than the compact text's length
    near = lambda reach: compact.rlike(rf"(?s)(?=(.{{4}})).{{1,{reach}}}\1")
    may = F.when(n < most + 4, False)
    for reach in (5, 20):
        may = may.when(n <= (reach + 1) * most + 3, near(reach))
    return F.coalesce(F.pandas_udf(_most_fourgrams, IntegerType())(F.when(may.otherwise(True), compact)) > most, F.lit(False))


def token_run_over(text: Column, most: int) -> Column:
    """Whether ``max_token_run`` is over ``most`` (1 or more): a token that's followed by itself so many times."""
    return lower(text).rlike(rf"(?U)(?<!\S)(\S++)(?:\s++\1(?!\S)){{{most}}}")


def transcript_guard(text: Column, seconds: Column) -> Column:
    """Reasons against a transcript: too long for its audio, or long with a 4-gram twelve times or more."""
    compact = letters_of(text)
    s = F.greatest(seconds, F.lit(0.1))
    long_ = F.when(F.length(compact) > F.greatest(F.lit(256), F.ceil(s * 40)), "transcript_too_long_for_audio")
    repeats = F.when((F.length(compact) > F.greatest(F.lit(160), F.ceil(s * 20))) & many_fourgrams(text, 11), "pathological_repetition")
    return F.array_compact(F.array(long_, repeats))


def safe_id(text: Column, fallback: str = "item") -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def merge_text(parts: Column) -> Column:
    """Join the trimmed texts in order, with a blank only between two alphanumeric characters. Null parts are empty."""

    def step(acc: Column, part: Column) -> Column:
        t = strip(F.coalesce(part, F.lit("")))
        glue = F.when(acc.rlike(r"[\p{L}\p{N}]$") & t.rlike(r"^[\p{L}\p{N}]"), " ").otherwise("")
        return F.when(acc == "", t).when(t == "", acc).otherwise(F.concat(acc, glue, t))

    return F.aggregate(parts, F.lit(""), step)


def detect_language(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), "Chinese").when(text.rlike(r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]"), "Japanese").otherwise("English")


#: Marks that may end a text.
END_MARKS = (";", ":", ",", ".", "!", "?", "…", ")", "]", "}", '"', "'", "“", "‘", "；", "：", "，", "。", "！", "？", "、", "……", "）", "】", "”", "’")


def add_punctuation(text: Column) -> Column:
    """Append a full stop where the trimmed text has no end mark: the wide one if there's a Han character anywhere."""
    t = strip(text)
    stop = F.when(t.rlike(r"[\x{4E00}-\x{9FFF}]"), "。").otherwise(".")
    return F.when((t == "") | F.substring(t, -1, 1).isin(*END_MARKS), t).otherwise(F.concat(t, stop))


#: Characters that a reader would spell out.
SPELLED_SYMBOLS = "0123456789@#$£€¥%&<>=^`~/\\+*°²³×÷"
#: Addresses, runs of capitals, Roman numerals, and abbreviations; a word begins and ends at any character that is no letter, number or underscore.
_SPELLED = r"https?://|www\.|[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.|(^|[^\p{L}\p{N}_])[A-Z]{2,}($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])[A-Za-zÀ-ÿ]{1,4}\."


def needs_normalization(text: Column) -> Column:
    """Whether a text holds what must be spelled out before it's read: digits and symbols, addresses, capitals, abbreviations."""
    symbols = "".join("\\" + c for c in SPELLED_SYMBOLS if not c.isdigit())
    return F.coalesce(text.rlike(rf"[0-9{symbols}]|{_SPELLED}"), F.lit(False))


def extract_llm_json(text: Column) -> Column:
    """The object in a model's answer: what a fence holds, else from the first brace to the last; null where neither parses to an object."""
    bare = strip(F.regexp_replace(strip(text), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    inner = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    # A value that isn't an object takes no other reading; what doesn't parse at all is cut to its braces.
    whole = F.try_parse_json(bare)
    kind = F.schema_of_variant(whole)
    return F.when(whole.isNotNull(), F.when(kind.startswith("OBJECT"), bare)).when(F.try_parse_json(inner).isNotNull(), inner)


def parse_asr_response(text: Column) -> Column:
    """language, transcript, uncertain_spans and error of a model's answer; the transcript must be a string and the spans an array of strings."""
    v = F.try_parse_json(extract_llm_json(text))
    get = lambda path: F.try_variant_get(v, path, "variant")
    said, spans = get("$.transcript"), get("$.uncertain_spans")
    kind = F.schema_of_variant(spans)
    no_text, no_spans = ~F.coalesce(F.schema_of_variant(said) == "STRING", F.lit(False)), ~F.coalesce(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    empty = F.coalesce(F.try_variant_get(v, "$.uncertain_spans", "string") == "[]", F.lit(False))
    error = F.when(v.isNull(), "no_json_object").when(no_text, "transcript_not_a_string").when(no_spans | ((kind == "ARRAY<VOID>") & ~empty), "uncertain_spans_not_a_string_array")
    keep = lambda c: F.when(error.isNull(), c)
    language = F.coalesce(strip(F.try_variant_get(v, "$.language", "string")), F.lit(""))
    return F.struct(keep(language).alias("language"), keep(strip(F.try_variant_get(v, "$.transcript", "string"))).alias("transcript"), keep(F.try_variant_get(v, "$.uncertain_spans", "array<string>")).alias("uncertain_spans"), error.alias("error"))


#: What a quality observation answers.
QUALITY_FIELDS = ("speech_complete", "natural_short_response", "breath_or_noise_only", "background_music", "sound_effects", "broadcast_crosstalk", "voice_disguise_effect", "low_snr", "clipping", "english_natural_code_switch", "english_excessive", "english_audio_text_consistent")


def parse_quality_response(text: Column) -> Column:
    """assessment (a boolean for each of ``QUALITY_FIELDS``; null with an error) and error: every field must be there and a boolean."""
    v = F.try_parse_json(extract_llm_json(text))
    of = lambda f, kind: F.try_variant_get(v, f"$.quality_assessment.{f}", kind)
    bad = [F.when(~F.coalesce(F.schema_of_variant(of(f, "variant")) == "BOOLEAN", F.lit(False)), f"{f}_not_a_boolean") for f in QUALITY_FIELDS]
    whole = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.quality_assessment", "variant")).startswith("OBJECT"), F.lit(False))
    error = F.when(v.isNull(), "no_json_object").when(~whole, "quality_assessment_missing").otherwise(F.coalesce(*bad))
    fields = F.struct(*(of(f, "boolean").alias(f) for f in QUALITY_FIELDS))
    return F.struct(F.when(error.isNull(), fields).alias("assessment"), error.alias("error"))


def title_dedup_key(title: Column) -> Column:
    return F.lower(letters_of(nfc(title)))


#: Code points with an emoji presentation (Unicode 15).
EMOJI = (
    (0x231A, 0x231B), (0x23E9, 0x23EC), (0x23F0, 0x23F0), (0x23F3, 0x23F3), (0x25FD, 0x25FE), (0x2614, 0x2615), (0x2648, 0x2653), (0x267F, 0x267F), (0x2693, 0x2693), (0x26A1, 0x26A1),
    (0x26AA, 0x26AB), (0x26BD, 0x26BE), (0x26C4, 0x26C5), (0x26CE, 0x26CE), (0x26D4, 0x26D4), (0x26EA, 0x26EA), (0x26F2, 0x26F3), (0x26F5, 0x26F5), (0x26FA, 0x26FA), (0x26FD, 0x26FD),
    (0x2705, 0x2705), (0x270A, 0x270B), (0x2728, 0x2728), (0x274C, 0x274C), (0x274E, 0x274E), (0x2753, 0x2755), (0x2757, 0x2757), (0x2795, 0x2797), (0x27B0, 0x27B0), (0x27BF, 0x27BF),
    (0x2B1B, 0x2B1C), (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF), (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A), (0x1F1E6, 0x1F1FF), (0x1F201, 0x1F201), (0x1F21A, 0x1F21A),
    (0x1F22F, 0x1F22F), (0x1F232, 0x1F236), (0x1F238, 0x1F23A), (0x1F250, 0x1F251), (0x1F300, 0x1F320), (0x1F32D, 0x1F335), (0x1F337, 0x1F37C), (0x1F37E, 0x1F393), (0x1F3A0, 0x1F3CA), (0x1F3CF, 0x1F3D3),
    (0x1F3E0, 0x1F3F0), (0x1F3F4, 0x1F3F4), (0x1F3F8, 0x1F43E), (0x1F440, 0x1F440), (0x1F442, 0x1F4FC), (0x1F4FF, 0x1F53D), (0x1F54B, 0x1F54E), (0x1F550, 0x1F567), (0x1F57A, 0x1F57A), (0x1F595, 0x1F596),
    (0x1F5A4, 0x1F5A4), (0x1F5FB, 0x1F64F), (0x1F680, 0x1F6C5), (0x1F6CC, 0x1F6CC), (0x1F6D0, 0x1F6D2), (0x1F6D5, 0x1F6D7), (0x1F6DC, 0x1F6DF), (0x1F6EB, 0x1F6EC), (0x1F6F4, 0x1F6FC), (0x1F7E0, 0x1F7EB),
    (0x1F7F0, 0x1F7F0), (0x1F90C, 0x1F93A), (0x1F93C, 0x1F945), (0x1F947, 0x1F9FF), (0x1FA70, 0x1FA7C), (0x1FA80, 0x1FA88), (0x1FA90, 0x1FABD), (0x1FABF, 0x1FAC5), (0x1FACE, 0x1FADB), (0x1FAE0, 0x1FAE8), (0x1FAF0, 0x1FAF8),
)
#: Characters that a variation selector turns into an emoji: keycap bases and symbols.
_EMOJI_BASE = r"[#*0-9\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}]"
#: Markdown marks taken away, in this order, with what stays of them.
MARKDOWN = (
    (r"!\[[^\]]*\]\([^\)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^(\s*)-\s+", "$1"),
    (r"(?m)^#{1,6}\s*", ""),
    (r"(?m)^\s*\*\*([^*]+)\*\*", "$1"),
    (r"(?m)^\s*__([^_]+)__", "$1"),
    (r"(?m)^\s*\*([^*]+)\*", "$1"),
    (r"(?m)^\s*~~([^~]+)~~", "$1"),
    (r"(?m)^\s*[*~]\s+", ""),
    (r"\n\s*\n", "\n"),
)


def clean_text(text: Column) -> Column:
    """Drop format characters (but the zero-width joiner), private use and replacement marks, Markdown marks at line starts, links and emoji; collapse white space."""
    t = F.regexp_replace(text, r"[\p{Cf}&&[^\x{200D}]]|\p{Co}", "")
    t = F.regexp_replace(F.translate(t, "\u00a0\u2028\u2029\ufffd", " \n\n"), r"\r\n?", "\n")
    for pattern, stays in MARKDOWN:
        t = F.regexp_replace(t, pattern, stays)
    return collapse_space(F.regexp_replace(strip(t), rf"[{char_class(EMOJI)}]|{_EMOJI_BASE}\x{{FE0F}}", ""))


_HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}"


def clean_tn_spaces(text: Column) -> Column:
    """Drop white space between Han characters, and between these and Latin letters or digits; each rule passes once, from left to right."""
    for left, right in ((f"[{_HAN}]", f"[{_HAN}]"), (f"[{_HAN}]", "[a-zA-Z0-9]"), ("[a-zA-Z0-9]", f"[{_HAN}]")):
        text = F.regexp_replace(text, rf"(?U)({left})\s+({right})", "$1$2")
    return text


#: Variants of marks and what they're read as.
SPOKEN_MARKS = {"〜": "~", "～": "~", "・": "·", "•": "·", "‧": "·", "…": "...", "⋯": "...", "〰": "...", "﹏": "..."}


def clean_spoken_output(text: Column) -> Column:
    """Spoken form without what can't be read: marks become blanks or commas, other symbols go, commas are collapsed."""
    for mark, read in SPOKEN_MARKS.items():
        text = F.replace(text, F.lit(mark), F.lit(read))
    text = F.regexp_replace(text, r"[·•‧│|¦/\\]", " ")
    text = F.regexp_replace(text, r"[…~&*%$#^:;/\\|]+", ",")
    text = F.regexp_replace(text, rf"(?U)[^{_HAN}0-9A-Za-z，。、？！：；…—～·.,:;!?()\[\]'\"\-_\s]", "")
    text = strip(F.regexp_replace(text, r"[ \t]+", " "))
    text = F.regexp_replace(F.regexp_replace(text, "[,，]{2,}", ","), r"(?U)\s+[,，]", ",")
    return F.regexp_replace(text, r"(?U)[,，]+\s*$", "")


def compose_training_text(prompt: Column, target: Column, language: Column) -> Column:
    """Style prefix with the language, then both texts, unchanged, between the text marks."""
    return F.concat(F.lit("<|lang_start|>"), language, F.lit("<|lang_end|><|instruct_start|>None<|instruct_end|><|text_start|>"), prompt, F.lit(" "), target, F.lit("<|text_end|>"))


def compose_tagged_text(prompt: Column, prompt_language: Column, target: Column, language: Column) -> Column:
    """The other format: each part behind the tag of its own language."""
    return F.concat(F.lit("<|"), prompt_language, F.lit("|>"), prompt, F.lit("<|"), language, F.lit("|>"), target)


#: The chat markup's system message.
CHAT_SYSTEM = "You are a helpful assistant."
#: What stands before the texts of each task.
CHAT_TASKS = {
    "tts": "Convert text to speech.\n",
    "voice_design": "\n\n根据上述音色描述，首先整理成语音属性，再合成以下文本对应的音频：\n",
    "semantic_edit": "Identify the content of the audio. ",
}


def compose_chat(text_in: Column, text_out: Column | str = "", audio_in: Column | int = 0, audio_out: Column | int = 0, pad_in: str = "<|video_pad|>", pad_out: str = "<|video_pad|>") -> Column:
    """Chat markup of one exchange; ``audio_in`` and ``audio_out`` count the places kept for audio, before and behind the texts."""
    as_column = lambda c: c if isinstance(c, Column) else F.lit(c)
    text_out, audio_in, audio_out = as_column(text_out), as_column(audio_in), as_column(audio_out)
    audio = lambda pad, n: F.when(n > 0, F.concat(F.lit("<|sosp|>"), F.repeat(F.lit(pad), n.cast("int")), F.lit("<|eosp|>\n"))).otherwise("")
    return F.concat(
        F.lit(f"<|im_start|>system\n{CHAT_SYSTEM}<|im_end|>\n<|im_start|>user\n"), audio(pad_in, audio_in), text_in, F.lit(" /no_think<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"),
        text_out, audio(pad_out, audio_out), F.lit("<|im_end|>\n"),
    )


def _open_ended(chat: Column, ending: str) -> Column:
    return F.when(F.endswith(chat, F.lit(ending)), F.substring(chat, F.lit(1), F.length(chat) - len(ending))).otherwise(chat)


def compose_tts_request(prompt: Column, text: Column, prompt_places: Column) -> Column:
    """Markup up to where the speech of ``text`` is to go on, behind the places of the prompt's audio."""
    return _open_ended(compose_chat(F.concat(F.lit(CHAT_TASKS["tts"]), prompt, text), audio_out=prompt_places), "<|eosp|>\n<|im_end|>\n")


def compose_voice_design_request(instruction: Column, text: Column) -> Column:
    return _open_ended(compose_chat(F.concat(instruction, F.lit(CHAT_TASKS["voice_design"]), text), "<|sot|>"), "<|im_end|>\n")


def compose_semantic_edit_request(instruction: Column, audio_places: Column) -> Column:
    return _open_ended(compose_chat(F.concat(F.lit(CHAT_TASKS["semantic_edit"]), strip(instruction)), "<|sot|>", audio_places), "<|im_end|>\n")


def compose_acoustic_edit_request(instruction: Column, audio_places: Column) -> Column:
    return _open_ended(compose_chat(instruction, "", audio_places, 1), "<|video_pad|><|eosp|>\n<|im_end|>\n")


#: Letters that tell Latin-script languages apart.
LANGUAGE_LETTERS = {"lt-LT": "ąčęėįšųūž", "de-DE": "äöüß", "fr-FR": "àâæçéèêëîïôœùûÿ", "es-MX": "ñ¿¡", "it-IT": "àèéìíîòóùú"}
#: Stop words of the same.
STOP_WORDS = {
    "de-DE": "und der die das ist ein nicht mit den von sie ich auf für auch wird im am",
    "en-US": "the and is are of to in for on with this that you it have was please at",
    "es-MX": "el la los las de que es un una por con para su se no más está del",
    "fr-FR": "le la les des est et un une vous que pour dans qui pas sur au du ce",
    "it-IT": "il la le di che è un una per con non sono del della gli nel ha si",
}
#: Code points of the scripts that are told apart, kana before Han.
SCRIPT_RANGES = {
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)),
    "hangul": ((0xAC00, 0xD7AF),),
    "cyrillic": ((0x0400, 0x04FF), (0x0500, 0x052F)),
    "arabic": ((0x0600, 0x06FF), (0x0750, 0x077F)),
    "devanagari": ((0x0900, 0x097F),),
    "thai": ((0x0E00, 0x0E7F),),
    "greek": ((0x0370, 0x03FF),),
}
_LATIN = r"[\p{L}&&[\x{0000}-\x{024F}]]"


def script_stats(text: Column) -> Column:
    """Characters of nine scripts; Latin ones are letters below U+0250."""
    counts = {k: F.regexp_count(text, F.lit(f"[{char_class(r)}]")) for k, r in SCRIPT_RANGES.items()} | {"latin": F.regexp_count(text, F.lit(_LATIN))}
    return F.struct(*(counts[k].alias(k) for k in ("han", "kana", "latin", "hangul", "cyrillic", "arabic", "devanagari", "thai", "greek")))


def detect_locale(text: Column, fallback: str = "zh-CN") -> Column:
    """Locale by script, then by letters and stop words of Latin-script languages; a tie or no evidence gives ``fallback``, other scripts too."""
    low = F.lower(text)
    has = lambda k: low.rlike(f"[{LANGUAGE_LETTERS[k]}]")
    more = {"de-DE": F.when(has("de-DE"), 1).otherwise(0) + F.when(F.contains(low, F.lit("ß")), 2).otherwise(0), "fr-FR": F.when(has("fr-FR"), 1).otherwise(0), "it-IT": F.when(has("it-IT"), 1).otherwise(0)}
    stops = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    # The stop words that a text has, found once; each language counts its own.
    held = F.array_intersect(F.regexp_extract_all(low, F.lit("[a-zà-ÿ]+"), F.lit(0)), F.array(*[F.lit(w) for w in stops]))

    def decide(found: Column) -> Column:
        score = F.array(*(F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in stop.split()]))) + more.get(k, F.lit(0)) for k, stop in STOP_WORDS.items()))
        pick = lambda s: F.when((F.array_max(s) > 0) & (F.size(F.filter(s, lambda x: x == F.array_max(s))) == 1), F.element_at(F.array(*[F.lit(k) for k in STOP_WORDS]), F.array_position(s, F.array_max(s)).cast("int")))
        return F.element_at(F.transform(F.array(score), pick), 1)

    latin = F.when(has("lt-LT"), "lt-LT").when(has("es-MX"), "es-MX").otherwise(F.coalesce(F.element_at(F.transform(F.array(held), decide), 1), F.lit(fallback)))
    seen = lambda k: text.rlike(f"[{char_class(SCRIPT_RANGES[k])}]")
    other = text.rlike("[" + "".join(char_class(SCRIPT_RANGES[k]) for k in ("hangul", "cyrillic", "arabic", "devanagari", "thai", "greek")) + "]")
    wide = text.rlike(r"[\x{3000}-\x{303F}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}]")
    return F.when(seen("kana"), "ja-JP").when(seen("han") | wide, "zh-CN").when(~other & text.rlike(_LATIN) & text.rlike("[A-Za-zÀ-ÿ]{3,}"), latin).otherwise(fallback)


#: Marks behind which a paragraph is cut.
CUT_MARKS = {"zh": "。？！；、.?!;", "other": ".?!;"}


def split_paragraph(text: Column, language: str = "zh", most: int = 80, least: int = 60, tail: int = 20) -> Column:
    """Pieces cut behind sentence marks (not at a point between digits; a closing quote goes with its mark), joined until one
    passes ``least`` and the next would pass ``most`` code points; a last piece shorter than ``tail`` joins the one before.

    A mark with nothing before it is left out; a text without any mark gets a wide stop in Chinese.
    """
    marks = CUT_MARKS["zh" if language == "zh" else "other"].replace(".", r"\.")
    kept = F.regexp_replace(text, r"(?<=\p{Nd})\.(?=\p{Nd})", "\x01")  # a stand-in for points between digits
    found = F.regexp_extract_all(kept, F.lit(rf"[^{marks}]+(?:[{marks}](?:[\"”]|[{marks}]+[\"”])?)?"), F.lit(0))
    pieces = F.transform(found, lambda p: F.translate(F.regexp_replace(p, rf"([{marks}])[{marks}]+([\"”])$", "$1$2"), "\x01", "."))
    if language == "zh":
        pieces = F.when((F.size(pieces) == 0) | ((F.size(pieces) == 1) & (F.get(pieces, F.lit(0)) == "")), F.array(F.concat(text, F.lit("。")))).otherwise(pieces)

    def step(acc: Column, p: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(p) > most) & (F.length(acc["now"]) > least)
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(full, p).otherwise(F.concat(acc["now"], p)).alias("now"))

    def end(acc: Column) -> Column:
        n, last = F.size(acc["done"]), F.try_element_at(acc["done"], F.lit(-1))
        joined = F.concat(F.slice(acc["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, acc["now"])))
        return F.when(acc["now"] == "", acc["done"]).when((F.length(acc["now"]) < tail) & (n > 0), joined).otherwise(F.concat(acc["done"], F.array(acc["now"])))

    return F.aggregate(pieces, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")), step, end)


#: Speaking weight of a character by kind; a Latin letter is 1.
SPEAKING_WEIGHTS = {
    "cjk": 3.0, "hangul": 2.5, "kana": 2.2, "ethiopic": 3.0, "yi": 3.0, "indic": 1.8, "thai_lao": 1.5, "khmer_myanmar": 1.8, "arabic": 1.5, "hebrew": 1.5,
    "latin": 1.0, "cyrillic": 1.0, "greek": 1.0, "armenian": 1.0, "georgian": 1.0, "punctuation": 0.5, "space": 0.2, "digit": 3.5, "mark": 0.0, "default": 1.0,
}
#: Last code point of each stretch, and its kind.
SPEAKING_RANGES = (
    (0x02AF, "latin"), (0x03FF, "greek"), (0x052F, "cyrillic"), (0x058F, "armenian"), (0x05FF, "hebrew"), (0x077F, "arabic"), (0x089F, "arabic"), (0x08FF, "arabic"),
    (0x097F, "indic"), (0x09FF, "indic"), (0x0A7F, "indic"), (0x0AFF, "indic"), (0x0B7F, "indic"), (0x0BFF, "indic"), (0x0C7F, "indic"), (0x0CFF, "indic"), (0x0D7F, "indic"), (0x0DFF, "indic"),
    (0x0EFF, "thai_lao"), (0x0FFF, "indic"), (0x109F, "khmer_myanmar"), (0x10FF, "georgian"), (0x11FF, "hangul"), (0x137F, "ethiopic"), (0x139F, "ethiopic"),
    (0x13FF, "default"), (0x167F, "default"), (0x169F, "default"), (0x16FF, "default"), (0x171F, "default"), (0x173F, "default"), (0x175F, "default"), (0x177F, "default"),
    (0x17FF, "khmer_myanmar"), (0x18AF, "default"), (0x18FF, "default"), (0x194F, "indic"), (0x19DF, "indic"), (0x19FF, "khmer_myanmar"), (0x1A1F, "indic"), (0x1AAF, "indic"), (0x1B7F, "indic"),
    (0x1BBF, "indic"), (0x1BFF, "indic"), (0x1C4F, "indic"), (0x1C7F, "indic"), (0x1C8F, "cyrillic"), (0x1CBF, "georgian"), (0x1CCF, "indic"), (0x1CFF, "indic"),
    (0x1D7F, "latin"), (0x1DBF, "latin"), (0x1DFF, "default"), (0x1EFF, "latin"), (0x309F, "kana"), (0x30FF, "kana"), (0x312F, "cjk"), (0x318F, "hangul"), (0x9FFF, "cjk"),
    (0xA4CF, "yi"), (0xA4FF, "default"), (0xA63F, "default"), (0xA69F, "cyrillic"), (0xA6FF, "default"), (0xA7FF, "latin"), (0xA82F, "indic"), (0xA87F, "default"), (0xA8DF, "indic"), (0xA8FF, "indic"),
    (0xA92F, "indic"), (0xA95F, "indic"), (0xA97F, "hangul"), (0xA9DF, "indic"), (0xA9FF, "khmer_myanmar"), (0xAA5F, "indic"), (0xAA7F, "khmer_myanmar"), (0xAADF, "indic"), (0xAAFF, "indic"),
    (0xAB2F, "ethiopic"), (0xAB6F, "latin"), (0xABBF, "default"), (0xABFF, "indic"), (0xD7AF, "hangul"), (0xFAFF, "cjk"), (0xFDFF, "arabic"), (0xFE6F, "default"), (0xFEFF, "arabic"), (0xFFEF, "latin"),
)


def weight_classes() -> dict[str, float]:
    """Character classes with a weight other than 1, each character in one: by category first, then by stretch."""
    of: dict[str, list] = {}
    begin = 0
    for last, kind in (*SPEAKING_RANGES, (0x20000, "default"), (0x10FFFF, "cjk")):
        if SPEAKING_WEIGHTS[kind] != 1.0:
            of.setdefault(kind, []).append((begin, last))
        begin = last + 1
    other = r"\p{M}\p{P}\p{S}\p{Z}\p{N}\x{0640}"
    spoken = {rf"[{char_class(r)}&&[^{other}]]": SPEAKING_WEIGHTS[k] for k, r in of.items()}
    return {r"[\p{M}\x{0640}]": SPEAKING_WEIGHTS["mark"], r"[\p{P}\p{S}]": SPEAKING_WEIGHTS["punctuation"], r"\p{Z}": SPEAKING_WEIGHTS["space"], r"\p{N}": SPEAKING_WEIGHTS["digit"]} | spoken


def speaking_weight(text: Column) -> Column:
    """Sum of the characters' speaking weights."""
    total = F.length(text).cast("double")
    for pattern, weight in weight_classes().items():
        total = total + F.regexp_count(text, F.lit(pattern)) * (weight - 1.0)
    return total


def estimate_duration(target: Column, reference: Column, reference_seconds: Column, boost_below: float | None = 50.0, strength: float = 3.0) -> Column:
    """Seconds of ``target`` at the reference's pace; estimates below ``boost_below`` are raised along a root of ``strength``. Without a reference 0."""
    weight = speaking_weight(reference)
    seconds = speaking_weight(target) * reference_seconds / F.nullif(weight, F.lit(0.0))
    if boost_below is not None:
        seconds = F.when(seconds < boost_below, F.pow(seconds / boost_below, F.lit(1.0 / strength)) * boost_below).otherwise(seconds)
    return F.when((F.coalesce(reference_seconds, F.lit(0)) <= 0) | (F.coalesce(weight, F.lit(0.0)) == 0), 0.0).otherwise(seconds)


#: Symbols that a transcript may hold.
ALLOWED_SYMBOLS = "%+&@#=/$-*°"


def abnormal_chars(text: Column, target: str = "my") -> Column:
    """Characters that a transcript of ``target`` shouldn't hold, in order: array of (character, reason).

    Controls, surrogates, private use, unassigned and replacement marks; format characters but zero-width blanks and joiners;
    symbols but the allowed ones; letters that are neither Latin nor of the target language. White space is fine.
    """
    symbols = "".join("\\" + c for c in ALLOWED_SYMBOLS)
    own = char_class(LANGUAGE_RANGES[target])

    def reason(c: Column) -> Column:
        return (
            F.when(c.rlike(r"(?U)^[\s\x{1C}-\x{1F}]$"), F.lit(None))
            .when(c.rlike(r"^[\p{Cc}\p{Cs}\p{Co}\p{Cn}\x{FFFD}]$"), "invalid_unicode_category")
            .when(c.rlike(r"^[\p{Cf}&&[^\x{200B}-\x{200D}]]$"), "unexpected_format_character")
            .when(c.rlike(rf"^[\p{{S}}&&[^{symbols}]]$"), "unexpected_symbol")
            .when(c.rlike(rf"^[\p{{L}}&&[^\p{{IsLatin}}{own}]]$"), "unexpected_letter_script")
        )

    found = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.struct(c.alias("character"), reason(c).alias("reason")))
    return F.filter(found, lambda x: x["reason"].isNotNull())


def text_quality(text: Column, target: str = "my", max_run: int = 3, max_gram: int = 11, max_latin: float = 0.65, least_letters: int = 0, least_ratio: float = 0.0) -> Column:
    """Reasons against a transcript, in a fixed order. ``text`` is a normalised one (``normalize_transcript``), as a column of its own."""
    t = text
    m = script_metrics(t)
    own = m[target] / F.greatest(m["letters"], F.lit(1))
    # One test of what isn't a common letter stands for the list of abnormal characters.
    symbols = "".join("\\" + c for c in ALLOWED_SYMBOLS)
    bad = rf"[\p{{Cc}}\p{{Cs}}\p{{Co}}\p{{Cn}}\x{{FFFD}}&&[^\s\x{{1C}}-\x{{1F}}\x{{85}}]]|[\p{{Cf}}&&[^\x{{200B}}-\x{{200D}}]]|[\p{{S}}&&[^{symbols}]]|[\p{{L}}&&[^\p{{IsLatin}}{char_class(LANGUAGE_RANGES[target])}]]"
    rules = [
        F.when(t == "", "empty_text"),
        F.when(_less_common(t).rlike(bad), "abnormal_characters"),
        F.when((token_run_over(t, max_run) if max_run > 0 else max_token_run(t) > max_run) | many_fourgrams(t, max_gram), "repetitive_text"),
        F.when(m["latin_ratio"] > max_latin, "excessive_english"),
    ]
    if least_letters > 0 or least_ratio > 0:
        rules.append(F.when((m[target] < least_letters) | (own < least_ratio), "insufficient_target_script"))
    return F.array_compact(F.array(*rules))


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "Rev.", "Fr.", "Hon.", "Pres.", "Gov.", "Capt.", "Gen.", "Sen.", "Rep.", "Col.", "Maj.", "Lt.", "Cmdr.", "Sgt.", "Cpl.", "Co.", "Corp.",
    "Inc.", "Ltd.", "Est.", "Dept.", "St.", "Ave.", "Blvd.", "Rd.", "Mt.", "Ft.", "No.", "Jan.", "Feb.", "Mar.", "Apr.", "Aug.", "Sep.", "Sept.", "Oct.", "Nov.", "Dec.", "i.e.", "e.g.", "vs.", "Vs.",
    "Etc.", "approx.", "fig.", "def.",
)
#: Marks that end a sentence, and marks that stay with the one before.
SENTENCE_MARKS = ".,;:!?。，；：！？"
CLOSING_MARKS = "\"'）]》>」】"


def chunk_text(text: Column, most: int = 100, least: int | None = None) -> Column:
    """Trimmed chunks of up to ``most`` code points, cut behind sentence marks but not behind abbreviations; closing marks stay at the left.

    A sentence longer than ``most`` is a chunk. With ``least``, a shorter chunk joins the one before it; a shorter first one takes the second.
    """
    mark, behind = re.compile(f"[{re.escape(SENTENCE_MARKS)}]"), re.compile(f"[{re.escape(SENTENCE_MARKS + CLOSING_MARKS)}]*")

    def cut(t: str | None) -> list[str] | None:
        if t is None:
            return None
        pieces, begin = [], 0
        for m in mark.finditer(t):
            end = m.end()
            if end <= begin or (m[0] == "." and t[begin:end].split()[-1] in ABBREVIATIONS):
                continue
            end = behind.match(t, end).end()
            pieces.append(t[begin:end])
            begin = end
        chunks: list[str] = []
        for piece in [*pieces, t[begin:]]:
            if piece and chunks and len(chunks[-1]) + len(piece) <= most:
                chunks[-1] += piece
            elif piece:
                chunks.append(piece)
        if least is not None:
            kept: list[str] = []
            for i, c in enumerate(chunks):
                if kept and (len(c) < least or (i == 1 and len(chunks[0]) < least)):
                    kept[-1] += c
                else:
                    kept.append(c)
            chunks = kept
        return [c.strip() for c in chunks if c.strip()]

    return F.pandas_udf(lambda s: s.map(cut), ArrayType(StringType()))(text)


#: Language names of locales.
LOCALE_NAMES = {
    "zh-CN": "Chinese", "en-US": "English", "ja-JP": "Japanese", "ko-KR": "Korean", "es-MX": "Spanish", "fr-FR": "French", "ru-RU": "Russian", "ar-SA": "Arabic", "tr-TR": "Turkish", "id-ID": "Indonesian",
    "pt-BR": "Portuguese", "it-IT": "Italian", "nl-NL": "Dutch", "vi-VN": "Vietnamese", "de-DE": "German", "uk-UA": "Ukrainian", "th-TH": "Thai", "pl-PL": "Polish", "ro-RO": "Romanian", "el-GR": "Greek",
    "cs-CZ": "Czech", "fi-FI": "Finnish", "hi-IN": "Hindi",
}
#: Dialects that are read as zh-CN.
CHINESE_DIALECTS = (
    "Cantonese", "ZH_Anhui", "ZH_Fujian", "ZH_Gansu", "ZH_Guizhou", "ZH_Hebei", "ZH_Henan", "ZH_Hubei", "ZH_Hunan", "ZH_Jiangxi", "ZH_Liaoning", "ZH_Minnan", "ZH_Ningxia",
    "ZH_Shaanxi", "ZH_Shandong", "ZH_Shanghai", "ZH_Shanxi", "ZH_Sichuan", "ZH_Tianjin", "ZH_Wenzhou", "ZH_Wu", "ZH_Yunnan",
)


def locale_of_language(name: Column) -> Column:
    """Locale of a language's or dialect's name; null for others."""
    pairs = {v: k for k, v in LOCALE_NAMES.items()} | dict.fromkeys(CHINESE_DIALECTS, "zh-CN")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), name)


def language_of_locale(locale: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LOCALE_NAMES.items() for x in kv]), locale)


def map_language(tag: Column, table: dict[str, str], fallback: str | None = None) -> Column:
    """Code of a language tag or name by the caller's ``table`` (lower-case keys)."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(tag))), F.lit(fallback))
