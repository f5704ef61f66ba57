"""Detection rules as data: categories of regular expressions and of literal motifs, by language."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import required

# The English expressions, by category, in their order.
ENGLISH = {
    "instruction_override": [
        r"ignore\s+(all\s+)?(previous|prior|above|earlier|preceding)\s+(instructions?|prompts?|rules?|guidelines?|directions?|commands?)",
        r"disregard\s+(all\s+)?(previous|prior|earlier|above|preceding)",
        r"forget\s+(everything\s+)?(above|before|prior|previous|earlier)",
        r"do\s+not\s+follow\s+(the\s+)?(previous|above|prior|earlier)",
        r"override\s+(all\s+)?(previous|prior|earlier)",
        r"stop\s+following\s+(your\s+)?(previous|original|initial)",
        r"new\s+instructions?\s*[:=]",
        r"actual\s+instructions?\s*[:=]",
        r"real\s+instructions?\s*[:=]",
        r"updated?\s+instructions?\s*[:=]",
    ],
    "role_injection": [
        r"you\s+are\s+now\s+",
        r"from\s+now\s+on\s*[,:]?\s*(you|your)",
        r"act\s+as\s+(if\s+)?(you\s+)?(are\s+|were\s+)?",
        r"pretend\s+(to\s+be|you\s+are|you're|that\s+you)",
        r"your\s+new\s+(role|goal|purpose|instruction|directive|objective)",
        r"imagine\s+(that\s+)?you\s+(are|were)",
        r"roleplay\s+as",
        r"switch\s+to\s+.{0,30}\s+mode",
        r"you\s+must\s+now\s+(act|be|become)",
        r"for\s+the\s+rest\s+of\s+this\s+(conversation|session|chat)",
        r"behave\s+(like|as)\s+(a|an)",
        r"assume\s+the\s+(role|identity|persona)",
        r"you\s+will\s+(now\s+)?(respond|act|behave)",
    ],
    "system_manipulation": [
        r"(admin|administrator|developer|god|sudo|root|maintenance|debug)\s+mode",
        r"system\s+(override|prompt|instruction|message|command)",
        r"unlock\s+(all\s+)?(restrictions?|capabilities?|features?|access)",
        r"disable\s+(all\s+)?(safety|security|content\s+)?(filters?|guards?|restrictions?|limits?)",
        r"bypass\s+(all\s+)?(restrictions?|filters?|safety|security|limits?)",
        r"enable\s+(unrestricted|unlimited|full)\s+(mode|access)",
        r"remove\s+(all\s+)?(limitations?|restrictions?|filters?)",
        r"without\s+(any\s+)?(restrictions?|limitations?|filters?)",
        r"turn\s+off\s+(safety|security|content)?\s*(filters?|checks?|restrictions?)",
        r"deactivate\s+(safety|security|content)\s+(filters?|checks?)",
        r"override\s+safety",
        r"ignore\s+(safety|content)\s+(guidelines?|policies?|filters?)",
    ],
    "prompt_leak": [
        r"reveal\s+(your\s+)?(system\s+)?(prompt|instructions?|directives?)",
        r"show\s+(me\s+)?(your\s+)?(system\s+)?(prompt|instructions?|rules?|directives?)",
        r"what\s+(are|is|were)\s+(your\s+)?(system\s+)?(prompt|instructions?|rules?|directives?)",
        r"(print|display|output|echo|write|repeat)\s+(your\s+)?(system\s+)?(prompt|instructions?|directives?)",
        r"tell\s+me\s+(your|the)\s+(system\s+)?(prompt|instructions?)",
        r"(initial|original|hidden|secret|base)\s+(prompt|instructions?|directives?)",
        r"what\s+were\s+you\s+(told|instructed|programmed)",
        r"(copy|paste|quote)\s+(your\s+)?(system\s+)?(prompt|instructions?)",
        r"(beginning|start)\s+of\s+(your\s+)?(prompt|instructions?)",
    ],
    "jailbreak_keywords": [
        r"\bDAN\b",
        r"\bjailbreak(ed|ing)?\b",
        r"do\s+anything\s+now",
        r"(evil|dark|shadow|unrestricted|unfiltered)\s+(mode|assistant|ai|version)",
        r"(no|without|ignore)\s+(ethical|moral)\s+(guidelines?|restrictions?|limits?)",
        r"hypothetically\s+(speaking|if)",
        r"for\s+(educational|research|academic)\s+purposes?\s+only",
        r"in\s+a\s+fictional\s+(scenario|world|context)",
        r"(opposite|anti)\s+day",
        r"chaos\s+mode",
        r"maximum\s+freedom",
        r"no\s+censorship",
        r"uncensored\s+(mode|response|version)",
        r"(bypass|skip|avoid)\s+(all\s+)?safeguards?",
    ],
    "encoding_markers": [
        r"base64\s*[:=]",
        r"decode\s+(this|the\s+following|below)",
        r"encoded\s+(message|instruction|prompt)",
        r"\\x[0-9a-fA-F]{2}",
        r"&#x?[0-9a-fA-F]+;",
        r"%[0-9a-fA-F]{2}",
        r"\\u[0-9a-fA-F]{4}",
        r"rot13",
        r"caesar\s+cipher",
    ],
    "suspicious_delimiters": [
        r"\[\s*system\s*\]",
        r"\[\s*instruction[s]?\s*\]",
        r"\[\s*admin\s*\]",
        r"\[\s*assistant\s*\]",
        r"\[\s*user\s*\]",
        r"<\|?\s*(system|instruction|user|assistant|im_start|im_end)\s*\|?>",
        r"###\s*(system|instruction|new\s+task)",
        r"\*\*\*\s*(override|system|admin)",
        r"={3,}\s*(system|instruction|override)",
        r"```\s*(system|instruction|override)",
        r"---\s*(system|instruction|begin)",
    ],
}
# The English motifs, by category, in their order.
MOTIFS = {
    "instruction_override": ["ignore previous", "ignore all", "disregard above", "forget everything", "new instructions", "actual instructions", "real instructions", "override previous", "stop following", "do not follow"],
    "role_injection": ["you are now", "from now on", "act as", "pretend to be", "your new role", "imagine you are", "roleplay as", "switch to mode", "behave like", "assume the role"],
    "system_manipulation": ["admin mode", "developer mode", "god mode", "sudo mode", "debug mode", "system override", "unlock restrictions", "disable safety", "bypass filters", "enable unrestricted", "remove limitations", "turn off filters"],
    "prompt_leak": ["reveal your prompt", "show me your instructions", "what are your rules", "print your prompt", "tell me your instructions", "initial prompt", "hidden instructions", "secret prompt", "beginning of prompt"],
    "jailbreak": ["do anything now", "jailbreak", "evil mode", "unrestricted mode", "unfiltered mode", "no ethical guidelines", "hypothetically speaking", "educational purposes only", "fictional scenario", "chaos mode", "no censorship", "bypass safeguards"],
    "delimiters": ["[system]", "[instruction]", "[admin]", "[assistant]", "<|system|>", "<|im_start|>", "### system", "*** override", "=== system", "``` system"],
}
#: Our own gates, one for each English expression above: whatever it matches in a normalised text contains one of these.
ANCHORS = {
    "instruction_override": [["ignore "], ["disregard "], ["forget "], ["do not follow "], ["override "], ["stop following "], ["new instruction"], ["actual instruction"], ["real instruction"], ["update"]],
    "role_injection": [["you are now "], ["from now on"], ["act as "], ["pretend "], ["your new "], ["imagine "], ["roleplay as"], ["switch to "], ["you must now "], ["for the rest of this "], ["behave "], ["assume the "], ["you will "]],
    "system_manipulation": [[" mode"], ["system "], ["unlock "], ["disable "], ["bypass "], ["enable "], ["remove "], ["without "], ["turn off "], ["deactivate "], ["override safety"], ["ignore "]],
    "prompt_leak": [["reveal "], ["show "], ["what "], ["prompt", "instruction", "directive"], ["tell me "], ["prompt", "instruction", "directive"], ["what were you "], ["prompt", "instruction"], ["beginning of ", "start of "]],
    "jailbreak_keywords": [["dan"], ["jailbreak"], ["do anything now"], ["evil ", "dark ", "shadow ", "unrestricted ", "unfiltered "], [" ethical ", " moral "], ["hypothetically "], ["for educational ", "for research ", "for academic "], ["in a fictional "], ["opposite day", "anti day"], ["chaos mode"], ["maximum freedom"], ["no censorship"], ["uncensored "], ["safeguard"]],
    "encoding_markers": [["base64"], ["decode "], ["encoded "], ["\\x"], ["&#"], ["%"], ["\\u"], ["rot13"], ["caesar cipher"]],
    "suspicious_delimiters": [["system"], ["instruction"], ["admin"], ["assistant"], ["user"], ["<"], ["###"], ["***"], ["==="], ["```"], ["---"]],
}
CATEGORIES = list(ENGLISH)
SHORT = dict(zip(CATEGORIES, ["override", "role", "system", "leak", "jailbreak", "encoding", "delimiters"], strict=True))
WEIGHTS = dict(zip(CATEGORIES, [3.0, 2.5, 3.0, 2.0, 2.5, 1.0, 1.5], strict=True))

#: Our own vocabularies of other languages: (to ignore, to reveal, you are now / act as, earlier, instructions).
#: Three rules follow for each language; richer files are given by path (``rule_files``).
VOCABULARY = {
    "es": (["ignora", "ignore", "olvida", "descarta"], ["revela", "muestra", "dime"], ["ahora eres", "actúa como", "finge ser"], ["anteriores?", "previas?", "previos?"], ["instrucciones", "reglas", "indicaciones"]),
    "fr": (["ignore[zr]?", "oublie[zr]?"], ["révèle[zr]?", "montre[zr]?", "affiche[zr]?"], ["tu es maintenant", "agis comme", "fais semblant"], ["précédente?s?", "antérieure?s?"], ["instructions", "consignes", "règles"]),
    "de": (["ignoriere?", "vergiss", "missachte"], ["zeige?", "verrate?", "enthülle"], ["du bist jetzt", "handle als", "tu so als"], ["vorherigen?", "bisherigen?", "obigen?"], ["anweisungen", "regeln", "befehle"]),
    "it": (["ignora", "dimentica"], ["rivela", "mostra", "dimmi"], ["ora sei", "agisci come", "fingi di essere"], ["precedenti", "sopra"], ["istruzioni", "regole"]),
    "pt": (["ignore", "esqueça", "desconsidere"], ["revele", "mostre", "diga"], ["agora você é", "aja como", "finja ser"], ["anteriores", "prévias"], ["instruções", "regras"]),
    "nl": (["negeer", "vergeet"], ["toon", "onthul", "vertel"], ["je bent nu", "gedraag je als", "doe alsof"], ["vorige", "eerdere"], ["instructies", "regels"]),
    "ru": (["игнорируй(?:те)?", "забудь(?:те)?"], ["покажи(?:те)?", "раскрой(?:те)?"], ["теперь ты", "веди себя как", "притворись"], ["предыдущие", "прежние"], ["инструкции", "правила"]),
    "ar": (["تجاهل", "انس"], ["اكشف", "اعرض"], ["أنت الآن", "تصرف مثل"], ["السابقة"], ["التعليمات", "القواعد"]),
    "hi": (["अनदेखा", "भूल जाओ"], ["दिखाओ", "बताओ"], ["अब तुम", "अब आप"], ["पिछले", "पहले"], ["निर्देश", "नियम"]),
    "zh": (["忽略", "无视", "忘记"], ["显示", "透露", "告诉我"], ["你现在是", "扮演"], ["之前的?", "以前的?", "上面的?"], ["指令", "指示", "规则"]),
    "ja": (["無視", "忘れて"], ["表示して", "教えて"], ["あなたは今", "のふりをして"], ["以前の", "前の", "上記の"], ["指示", "命令", "ルール"]),
    "ko": (["무시", "잊어"], ["보여", "알려"], ["너는 이제", "당신은 이제"], ["이전", "앞의"], ["지시", "명령", "규칙"]),
}
UNSPACED = {"zh", "ja", "ko", "ar", "hi"}
LANGUAGES = ["en", *VOCABULARY]


def _other(lang: str) -> dict[str, list[str]]:
    drop, show, role, earlier, orders = ("(?:" + "|".join(x) + ")" for x in VOCABULARY[lang])
    if lang in ("zh", "ja", "ko", "hi"):  # verbs may follow their object
        return {"instruction_override": [f"{drop}.{{0,12}}{orders}", f"{earlier}\\s*{orders}.{{0,12}}{drop}"], "role_injection": [role], "prompt_leak": [f"{show}.{{0,12}}{orders}", f"{orders}.{{0,8}}{show}"]}
    return {"instruction_override": [rf"{drop}\s+(?:\S+\s+){{0,3}}{orders}\s*{earlier}?"], "role_injection": [role.replace(" ", r"\s+")], "prompt_leak": [rf"{show}\s+(?:\S+\s+){{0,3}}{orders}"]}


@dataclass(frozen=True)
class Rule:
    """``anchors``: a match in a normalised text contains one of them; none where nothing is known."""

    rule_id: int
    lang: str
    category: str
    kind: str
    expr: str
    anchors: tuple[str, ...] = ()


def _motifs(lang: str) -> dict[str, list[str]]:
    return MOTIFS if lang == "en" else {"role_injection": VOCABULARY[lang][2]}


def rules(languages: list[str] | None = None) -> list[Rule]:
    """The shipped rules of ``languages``; ``all`` or None for every language. Unknown languages have none."""
    wanted = LANGUAGES if not languages or "all" in languages else [x.lower() for x in languages]
    out: list[Rule] = []
    for lang in LANGUAGES:
        if lang in wanted:
            for kind, tables in (("regex", ENGLISH if lang == "en" else _other(lang)), ("motif", _motifs(lang))):
                for category, exprs in tables.items():
                    gates = ANCHORS[category] if (lang, kind) == ("en", "regex") else [required(e) if kind == "regex" else () for e in exprs]
                    out += [Rule(len(out) + i, lang, category, kind, e, tuple(g)) for i, (e, g) in enumerate(zip(exprs, gates, strict=True))]
    return out


def from_files(spark: SparkSession, loaded: DataFrame, languages: list[str] | None = None) -> list[Rule]:
    """Rules to detect with: of each language its first file (``rule_files.load``; a bounded list), else the shipped rules.

    Expressions that do not compile are left out.
    """
    rows = by_priority(loaded).select("lang", "category", "kind", "expr").collect()
    good = set(valid(spark, sorted({r["expr"] for r in rows if r["kind"] == "regex"})))
    given = {r["lang"] for r in rows}
    out = [r for r in rules(languages) if r.lang not in given]
    out += [Rule(0, r["lang"], r["category"], r["kind"], r["expr"], required(r["expr"]) if r["kind"] == "regex" else ()) for r in rows if r["kind"] == "motif" or r["expr"] in good]
    return [Rule(i, r.lang, r.category, r.kind, r.expr, r.anchors) for i, r in enumerate(out)]


def on_normalized(rule: Rule) -> str:
    """The expression for texts in lower case with single blanks, where it can be said more cheaply."""
    if rule.lang != "en" or not rule.anchors:
        return java(rule.expr)
    plain = re.sub(r"(?<!\\)[A-Z]", lambda m: m[0].lower(), rule.expr.replace(r"\s+", " ").replace(r"\s*", " ?"))
    return ("(?U)" if r"\b" in plain else "") + plain


def table_of(chosen: list[Rule], kind: str, column: Callable[[Rule], str], anchors: Callable[[Rule], tuple[str, ...]] = lambda r: r.anchors) -> Column:
    """The rules of one kind as one constant array of (category, anchors, expr): plans stay small however many there are."""
    each = [F.struct(F.lit(r.category).alias("category"), F.array(*map(F.lit, anchors(r))).cast("array<string>").alias("anchors"), F.lit(column(r)).alias("expr")) for r in chosen if r.kind == kind]
    return F.array(*each) if each else F.expr("cast(array() as array<struct<category:string,anchors:array<string>,expr:string>>)")


def may_match(text: Column, table: Column) -> Column:
    """The rules of ``table`` whose anchors the text allows."""
    return F.filter(table, lambda r: (F.size(r["anchors"]) == 0) | F.exists(r["anchors"], lambda a: F.contains(text, a)))


def rules_frame(spark: SparkSession, languages: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.lang, r.category, r.kind, r.expr) for r in rules(languages)], "rule_id int, lang string, category string, kind string, expr string")


def settings_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, x not in UNSPACED) for x in LANGUAGES if x in UNSPACED or x == "en"], "lang string, word_boundaries boolean")


def by_priority(files: DataFrame) -> DataFrame:
    """Of rows (lang, priority, ...) those of each language's first file: whole files override, they do not merge."""
    first = files.groupBy("lang").agg(F.min("priority").alias("priority"))
    return files.join(F.broadcast(first), ["lang", "priority"])  # a row per language


def valid(spark: SparkSession, exprs: list[str]) -> list[str]:
    """Those that java.util.regex compiles; others are skipped, as files of rules may be broken."""
    out = []
    for e in exprs:
        try:
            spark._jvm.java.util.regex.Pattern.compile(java(e))
            out.append(e)
        except Exception:
            continue
    return out


def valid_rows(df: DataFrame, expr: str = "expr") -> DataFrame:
    """The rows whose expression compiles, tried in tasks, however many there are."""

    def good(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[_compiles(e) for e in frame[expr]]]

    return df.mapInPandas(good, df.schema)


def _compiles(expr: str | None) -> bool:
    if expr is None:
        return False
    try:
        re.compile(expr)
    except re.error:
        return False
    return True


def java(expr: str) -> str:
    """Unicode-aware and without regard to case."""
    return f"(?iU){expr}"


def total_matches(text: Column, exprs: list[str]) -> Column:
    """Matches of all rules; every rule counts its own, so overlaps count twice. 0 without rules."""
    out = F.lit(0)
    for e in exprs:
        out = out + F.regexp_count(text, F.lit(java(e)))
    return out
