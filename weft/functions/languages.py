"""Languages: codes, scripts, punctuation conventions, what systems support, and which model a request goes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code of language and script, code for processing, unique short code.
LANGUAGES = [
    ("asm_Beng", "as", "as"),
    ("awa_Deva", "hi", "awa"),
    ("ben_Beng", "bn", "bn"),
    ("bho_Deva", "hi", "bho"),
    ("brx_Deva", "hi", "brx"),
    ("doi_Deva", "hi", "doi"),
    ("eng_Latn", "en", "en"),
    ("gom_Deva", "kK", "gom"),
    ("guj_Gujr", "gu", "gu"),
    ("hin_Deva", "hi", "hi"),
    ("hne_Deva", "hi", "hne"),
    ("kan_Knda", "kn", "kn"),
    ("kas_Arab", "ur", "ksa"),
    ("kas_Deva", "hi", "ksd"),
    ("kha_Latn", "en", "kha"),
    ("lus_Latn", "en", "lus"),
    ("mag_Deva", "hi", "mag"),
    ("mai_Deva", "hi", "mai"),
    ("mal_Mlym", "ml", "ml"),
    ("mar_Deva", "mr", "mr"),
    ("mni_Beng", "bn", "mnib"),
    ("mni_Mtei", "hi", "mnim"),
    ("npi_Deva", "ne", "ne"),
    ("ory_Orya", "or", "or"),
    ("pan_Guru", "pa", "pa"),
    ("san_Deva", "hi", "sa"),
    ("sat_Olck", "or", "sat"),
    ("snd_Arab", "ur", "sda"),
    ("snd_Deva", "hi", "sdd"),
    ("tam_Taml", "ta", "ta"),
    ("tel_Telu", "te", "te"),
    ("urd_Arab", "ur", "ur"),
]

# Further short codes of languages written in two scripts.
TWO_SCRIPTS = [
    ("ks", "kas_Arab"),
    ("ks_Deva", "kas_Deva"),
    ("mni", "mni_Mtei"),
    ("mni_Beng", "mni_Beng"),
    ("sd", "snd_Arab"),
    ("sd_Deva", "snd_Deva"),
]

# The punctuation convention of each language.
PUNCTUATION = [
    ("asm_Beng", "hi"),
    ("ben_Beng", "hi"),
    ("brx_Deva", "hi"),
    ("doi_Deva", "hi"),
    ("gom_Deva", "hi"),
    ("guj_Gujr", "hi"),
    ("hin_Deva", "hi"),
    ("kan_Knda", "hi"),
    ("kas_Deva", "hi"),
    ("mai_Deva", "hi"),
    ("mar_Deva", "hi"),
    ("mal_Mlym", "hi"),
    ("mni_Beng", "hi"),
    ("npi_Deva", "hi"),
    ("ory_Orya", "hi"),
    ("pan_Guru", "hi"),
    ("san_Deva", "hi"),
    ("sat_Olck", "hi"),
    ("snd_Deva", "hi"),
    ("tam_Taml", "hi"),
    ("tel_Telu", "hi"),
    ("eng_Latn", "en"),
    ("mni_Mtei", "en"),
    ("kas_Arab", "ar"),
    ("snd_Arab", "ar"),
    ("urd_Arab", "ar"),
]

# Languages that each system supports, and the system's code for them.
SYSTEMS = [
    ("m2m100", "eng_Latn", "en"),
    ("m2m100", "ben_Beng", "bn"),
    ("m2m100", "guj_Gujr", "gu"),
    ("m2m100", "hin_Deva", "hi"),
    ("m2m100", "kan_Knda", "kn"),
    ("m2m100", "mal_Mlym", "ml"),
    ("m2m100", "mar_Deva", "mr"),
    ("m2m100", "npi_Deva", "ne"),
    ("m2m100", "ory_Orya", "or"),
    ("m2m100", "pan_Guru", "pa"),
    ("m2m100", "snd_Arab", "sd"),
    ("m2m100", "tam_Taml", "ta"),
    ("m2m100", "urd_Arab", "ur"),
    ("mbart", "eng_Latn", "en_XX"),
    ("mbart", "guj_Gujr", "gu_IN"),
    ("mbart", "hin_Deva", "hi_IN"),
    ("mbart", "npi_Deva", "ne_NP"),
    ("mbart", "ben_Beng", "bn_IN"),
    ("mbart", "mal_Mlym", "ml_IN"),
    ("mbart", "mar_Deva", "mr_IN"),
    ("mbart", "tam_Taml", "ta_IN"),
    ("mbart", "tel_Telu", "te_IN"),
    ("mbart", "urd_Arab", "ur_PK"),
    ("nllb", "asm_Beng", "asm_Beng"),
    ("nllb", "ben_Beng", "ben_Beng"),
    ("nllb", "guj_Gujr", "guj_Gujr"),
    ("nllb", "eng_Latn", "eng_Latn"),
    ("nllb", "hin_Deva", "hin_Deva"),
    ("nllb", "kas_Deva", "kas_Deva"),
    ("nllb", "kas_Arab", "kas_Arab"),
    ("nllb", "kan_Knda", "kan_Knda"),
    ("nllb", "mal_Mlym", "mal_Mlym"),
    ("nllb", "mai_Deva", "mai_Deva"),
    ("nllb", "mar_Deva", "mar_Deva"),
    ("nllb", "mni_Beng", "mni_Beng"),
    ("nllb", "npi_Deva", "npi_Deva"),
    ("nllb", "ory_Orya", "ory_Orya"),
    ("nllb", "pan_Guru", "pan_Guru"),
    ("nllb", "san_Deva", "san_Deva"),
    ("nllb", "snd_Arab", "snd_Arab"),
    ("nllb", "sat_Olck", "sat_Beng"),
    ("nllb", "tam_Taml", "tam_Taml"),
    ("nllb", "tel_Telu", "tel_Telu"),
    ("nllb", "urd_Arab", "urd_Arab"),
    ("google", "asm_Beng", "as"),
    ("google", "ben_Beng", "bn"),
    ("google", "doi_Deva", "doi"),
    ("google", "eng_Latn", "en"),
    ("google", "gom_Deva", "gom"),
    ("google", "guj_Gujr", "gu"),
    ("google", "hin_Deva", "hi"),
    ("google", "kan_Knda", "kn"),
    ("google", "mai_Deva", "mai"),
    ("google", "mal_Mlym", "ml"),
    ("google", "mar_Deva", "mr"),
    ("google", "mni_Mtei", "mni-Mtei"),
    ("google", "npi_Deva", "ne"),
    ("google", "ory_Orya", "or"),
    ("google", "pan_Guru", "pa"),
    ("google", "san_Deva", "sa"),
    ("google", "sat_Olck", "sat"),
    ("google", "snd_Arab", "sd"),
    ("google", "tam_Taml", "ta"),
    ("google", "tel_Telu", "te"),
    ("google", "urd_Arab", "ur"),
    ("azure", "asm_Beng", "as"),
    ("azure", "ben_Beng", "bn"),
    ("azure", "brx_Deva", "brx"),
    ("azure", "doi_Deva", "doi"),
    ("azure", "eng_Latn", "en"),
    ("azure", "gom_Deva", "gom"),
    ("azure", "guj_Gujr", "gu"),
    ("azure", "hin_Deva", "hi"),
    ("azure", "kan_Knda", "kn"),
    ("azure", "kas_Arab", "ks"),
    ("azure", "kas_Deva", "ks_Deva"),
    ("azure", "mai_Deva", "mai"),
    ("azure", "mal_Mlym", "ml"),
    ("azure", "mar_Deva", "mr"),
    ("azure", "mni_Beng", "mni_Beng"),
    ("azure", "mni_Mtei", "mni"),
    ("azure", "npi_Deva", "ne"),
    ("azure", "ory_Orya", "or"),
    ("azure", "pan_Guru", "pa"),
    ("azure", "san_Deva", "sa"),
    ("azure", "sat_Olck", "sat"),
    ("azure", "snd_Arab", "sd"),
    ("azure", "snd_Deva", "sd_Deva"),
    ("azure", "tam_Taml", "ta"),
    ("azure", "tel_Telu", "te"),
    ("azure", "urd_Arab", "ur"),
    ("comet", "asm_Beng", "asm_Beng"),
    ("comet", "ben_Beng", "ben_Beng"),
    ("comet", "guj_Gujr", "guj_Gujr"),
    ("comet", "hin_Deva", "hin_Deva"),
    ("comet", "kan_Knda", "kan_Knda"),
    ("comet", "mal_Mlym", "mal_Mlym"),
    ("comet", "mar_Deva", "mar_Deva"),
    ("comet", "ory_Orya", "ory_Orya"),
    ("comet", "pan_Guru", "pan_Guru"),
    ("comet", "tam_Taml", "tam_Taml"),
    ("comet", "tel_Telu", "tel_Telu"),
    ("comet", "urd_Arab", "urd_Arab"),
]

#: Scripts whose text is not converted to the common script.
OWN_SCRIPTS = ["Arab", "Aran", "Olck", "Mtei", "Latn"]


def language_rows() -> list[tuple[str, str, str]]:
    return LANGUAGES


def iso_rows() -> list[tuple[str, str]]:
    """Short code and full code; the codes of two-script languages come on top."""
    known = {iso: flores for flores, _, iso in LANGUAGES}
    return sorted((known | dict(TWO_SCRIPTS)).items())


def punctuation_rows() -> list[tuple[str, str]]:
    return sorted(PUNCTUATION)


def system_rows() -> list[tuple[str, str, str]]:
    """System, language, the system's code for it."""
    return SYSTEMS


def systems_named(systems: DataFrame, part: str) -> DataFrame:
    """Rows of the systems (column system) whose name holds part."""
    return systems.filter(F.contains("system", F.lit(part)))


def language_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(language_rows(), "flores string, proc_code string, iso string")


def iso_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(iso_rows(), "iso string, flores string")


def punctuation_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(punctuation_rows(), "code string, punct_lang string")


def system_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(system_rows(), "system string, flores string, sys_code string")


def script_of(code: Column) -> Column:
    return F.substring_index(code, "_", -1)


def needs_transliteration(code: Column) -> Column:
    """Whether text of this language is converted to the common script."""
    return ~script_of(code).isin(OWN_SCRIPTS)


def punctuation_language(codes: DataFrame, code_col: str = "code") -> DataFrame:
    """codes and punct_lang: the convention of the exact code, else of the first listed with its first three letters, else en."""
    dim = punctuation_dim(codes.sparkSession)
    exact = dim.select(F.col("code").alias("__exact"), F.col("punct_lang").alias("__p1"))
    near = dim.groupBy(F.substring("code", 1, 3).alias("__near")).agg(F.min_by("punct_lang", "code").alias("__p2"))
    told = codes.join(F.broadcast(exact), F.col(code_col) == F.col("__exact"), "left").join(F.broadcast(near), F.substring(code_col, 1, 3) == F.col("__near"), "left")
    return told.withColumn("punct_lang", F.coalesce("__p1", "__p2", F.lit("en"))).drop("__exact", "__near", "__p1", "__p2")


def direction(src: Column, tgt: Column, known: list[str] | None = None, pivot: str = "en") -> Column:
    """The model a request goes to, by short codes; null if no model covers it.  The pivot is among the known languages."""
    codes = known or [iso for iso, _ in iso_rows()]
    return F.when((src == pivot) & tgt.isin(codes), "en-indic").when(src.isin(codes) & (tgt == pivot), "indic-en").when(src.isin(codes) & tgt.isin(codes), "indic-indic")


def hops(src: Column, tgt: Column, direct: list[str], pivot: str = "en") -> Column:
    """The steps (src, tgt) that a request takes: one where a model covers it, two over the pivot otherwise."""
    way = direction(src, tgt)
    step = lambda a, b: F.struct(a.alias("src"), b.alias("tgt"))
    refuse = F.raise_error(F.concat(F.lit("language pair not supported: "), src, F.lit("-"), tgt))
    two = F.array(step(src, F.lit(pivot)), step(F.lit(pivot), tgt))
    return F.when(way.isin(direct), F.array(step(src, tgt))).when((way == "indic-indic") & F.lit({"en-indic", "indic-en"} <= set(direct)), two).otherwise(F.array(F.struct(refuse.cast("string").alias("src"), tgt.alias("tgt"))))
