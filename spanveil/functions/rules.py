"""Detection patterns, label tables and scalar column functions for personal data."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detection patterns whose matches are part of the results.
DIGIT_RUN = r"\d(?:[ .-]?\d)*"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
URL_SCHEME = r"\bhttps?://[^\s<>\"'\])}]+"
URL_WWW = r"\bwww\.[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/[^\s<>\"'\])}]*)?"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"

# Cues that carry a value, in the order in which labels are listed.
VALUE_CUES = (
    ("CVC", r"\b(?:cvv2?|cvc2?|security\s+c[o0]de)\b\s*(?:[:=]|is)\s*\d{3,4}\b"),
    ("PRIVATE_KEY", r"\bBEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY\b"),
    ("API_KEY", r"\b(?:api[\s_-]*key|client\s+secret|access[\s_-]*key)\b\s*(?:[:=]|is)\s*[^\s,;]{6,}"),
    ("AUTH_TOKEN", r"\b(?:authorization|bearer|auth[\s_-]*token|access[\s_-]*token)\b\s*(?:[:=]|is)?\s*[^\s,;]{8,}"),
    ("PASSWORD", r"\b(?:password|passcode|passphrase)\b\s*(?:[:=]|is)\s*[^\s,;]{3,}"),
    ("CARD_NUMBER", r"\b(?:card\s+(?:number|no\.?|#)|credit\s+card|debit\s+card|pan)\b\s*(?:[:=]|is)?\s*\d(?:[ .-]?\d){11,18}"),
    ("GOVERNMENT_ID", r"\b(?:social\s+security|ssn|passport|driver'?s?\s+licen[cs]e|tax\s+id)\b\s*(?:[:=]|is)\s*[A-Z0-9][A-Z0-9 -]{4,}"),
    ("DOB", r"\b(?:date\s+of\s+birth|d[.\s/-]*o[.\s/-]*b[.]?)\b\s*(?:[:=]|is)\s*\d{1,4}[./-]\d{1,2}[./-]\d{1,4}"),
    ("BANK_ACCOUNT", r"\b(?:routing\s+(?:number|no\.?|#)|bank\s+account|account\s+(?:number|no\.?|#)|iban)\b\s*(?:[:=]|is)\s*[A-Z0-9 -]{5,}"),
    ("SECRET", r"\b(?:secret\s+(?:key|value)|recovery\s+(?:code|phrase)|seed\s+phrase)\b\s*(?:[:=]|is)\s*[^\s,;]{4,}"),
    ("PHONE", r"\b(?:phone|mobile|telephone|tel|call|sms)\b[^\n]{0,28}\+?\d[\d\s().-]{6,}\d(?:\s*(?:ext|x|extension)\s*\d+)?"),
    ("API_KEY", r"\b(?:sk[-_](?:test|live)[-_][a-z0-9_-]{8,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{20,})\b"),
    ("AUTH_TOKEN", r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*"),
    ("BANK_ACCOUNT", r"\b[A-Z]{2}\d{2}(?:[\s-]?[A-Z0-9]){11,30}\b"),
)

# Classes, aliases and levels of the policy.
CLASS_ALIASES = {
    "GIVEN_NAME": "NAME",
    "SURNAME": "NAME",
    "CREDIT_CARD": "CARD_NUMBER",
    "CREDIT_CARD_NUMBER": "CARD_NUMBER",
    "CREDIT_CARD_CVV": "CVC",
    "GOVERNMENT_ID": "GOV_ID",
    "SOCIAL_SECURITY_NUMBER": "SSN",
    "BUILDING_NUMBER": "ADDRESS",
    "STREET_NAME": "ADDRESS",
    "SECONDARY_ADDRESS": "ADDRESS",
}
POLICY = {
    "NAME": "hide_use",
    "EMAIL": "hide_use",
    "PHONE": "hide_use",
    "ADDRESS": "hide_use",
    "DOB": "hide_use",
    "GOV_ID": "blocked",
    "SSN": "blocked",
    "BANK_ACCOUNT": "blocked",
    "CARD_NUMBER": "blocked",
    "CVC": "blocked",
    "PASSWORD": "blocked",
    "API_KEY": "approval",
    "AUTH_TOKEN": "approval",
    "PRIVATE_KEY": "blocked",
    "SECRET": "blocked",
}
LEVELS = ("hide_use", "approval", "blocked")
CREDENTIALS = ("API_KEY", "AUTH_TOKEN", "PASSWORD", "CVC", "CARD_NUMBER", "PRIVATE_KEY", "SECRET")
TRAINING_CREDENTIALS = ("API_KEY", "AUTH_TOKEN", "PRIVATE_KEY", "PASSWORD")
KEEP_LABELS = ("CITY", "STATE", "ZIP_CODE", "URL")
SECRET_CLASSES = ("CARD_NUMBER", "CVC", "SECRET")
PLACEHOLDER = r"[A-Z][A-Z0-9_]*_[1-9][0-9]*_[0-9a-f]{4}"

# Source labels of training data and what they map to.
SOURCE_LABELS = {
    "GIVENNAME": "NAME",
    "SURNAME": "NAME",
    "STREET": "ADDRESS",
    "BUILDINGNUM": "ADDRESS",
    "BUILDINGNUMBER": "ADDRESS",
    "CITY": "ADDRESS",
    "ZIPCODE": "ADDRESS",
    "SOCIALNUM": "GOV_ID",
    "SOCIALNUMBER": "GOV_ID",
    "SSN": "GOV_ID",
    "IDCARDNUM": "GOV_ID",
    "IDCARDNUMBER": "GOV_ID",
    "PASSPORTNUM": "GOV_ID",
    "PASSPORTNUMBER": "GOV_ID",
    "DRIVERLICENSENUM": "GOV_ID",
    "DRIVERLICENSENUMBER": "GOV_ID",
    "TAXNUM": "GOV_ID",
    "EMAIL": "EMAIL",
    "TELEPHONENUM": "PHONE",
    "TELEPHONENUMBER": "PHONE",
    "PHONE": "PHONE",
    "CREDITCARDNUMBER": "CARD_NUMBER",
}
BIRTH_CONTEXT = r"(?i)\b(?:date\s+of\s+birth|birth\s*date|dob|born|birthday)\b"
ADDRESS_CONTEXT = r"(?i)\b(?:address|street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|boulevard|blvd\.?|drive|dr\.?|way|court|ct\.?|terrace|suite|apt\.?|apartment|ship\s+to|deliver\s+to)\b"
NAME_CONTEXT = r"(?i)\b(?:full\s+name|name|named|contact(?:\s+person)?|recipient|applicant|employee|customer|patient|signed\s+in\s+as|mr\.?|mrs\.?|ms\.?|miss|dr\.?|prof\.?)\b"
PERSON_CUE = r"(?i)\b(?:name|user|contact|recipient|customer|employee)\s*[:=]?\s*$"

SPAN = "struct<start:int,end:int,label:string,score:double,source:string,text:string>"


def mapping(pairs: dict[str, str]) -> Column:
    """A map literal."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def digits(text: Column) -> Column:
    """The ASCII digits of a text."""
    return F.regexp_replace(text, "[^0-9]", "")


def valid_ssn(d: Column) -> Column:
    """Whether nine digits can be a social security number."""
    area = F.substring(d, 1, 3)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


def luhn_digit(body: Column) -> Column:
    """The check digit that makes a digit string pass the Luhn check."""
    value = lambda x, i: F.when(F.pmod(F.length(body) - i, F.lit(2)) == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
    each = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(each, value), F.lit(0), lambda a, b: a + b)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def card_or_ssn(run: Column) -> Column:
    """The class of a digit run: CREDIT_CARD, SSN or null."""
    d = digits(run)
    return F.when(F.length(d).between(14, 16) & F.call_function("luhn_check", d), "CREDIT_CARD").when(valid_ssn(d), "SSN")


def normal_class(label: Column) -> Column:
    """A label's policy class."""
    name = F.trim(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.element_at(mapping(CLASS_ALIASES), name), name)


def level_of(label: Column, policy: dict[str, str] | None = None) -> Column:
    """The safety level of a label; unknown classes are blocked."""
    return F.coalesce(F.element_at(mapping(POLICY | (policy or {})), normal_class(label)), F.lit("blocked"))


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical(label: Column, value: Column, credentials: tuple[str, ...] = CREDENTIALS) -> Column:
    """What equal values share: credentials as they are, others without case and extra white space."""
    return F.when(normal_class(label).isin(*credentials), value).otherwise(F.lower(collapse(value)))


def value_cues(text: Column) -> Column:
    """Labels of the cues with a value in a text, as listed (a label may repeat)."""
    return F.filter(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(k)) for k, p in VALUE_CUES]), lambda x: x.isNotNull())


def source_label(label: Column) -> Column:
    """A source label without separators and a trailing number."""
    return F.regexp_replace(F.regexp_replace(F.upper(label), "[-_]", ""), r"\d+$", "")


def mapped_label(text: Column, label: Column, start: Column) -> Column:
    """The class of a source label; a date is a birth date only after words that say so."""
    name = source_label(label)
    before = F.substring(text, F.greatest(F.lit(1), start - 47), F.least(start, F.lit(48)))
    birth = name.isin("DATEOFBIRTH", "DOB") | ((name == "DATE") & before.rlike(BIRTH_CONTEXT))
    return F.coalesce(F.element_at(mapping(SOURCE_LABELS), name), F.when(birth, "DOB"))


def hash_share(key: Column) -> Column:
    """A key's share in [0, 1], from the first eight hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / F.lit(0xFFFFFFFF)


def hash_seed(key: Column) -> Column:
    """A key's integer seed, from the first twelve hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("long")


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def fingerprint(text: Column) -> Column:
    return F.struct(F.sha2(text, 256).alias("sha256"), F.length(text).alias("characters"))


def safe_stem(name: Column, key: Column, width: int = 10) -> Column:
    """A file stem out of any name, told apart by a hash of its key."""
    stem = F.trim(F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "-"), F.lit("-"))
    return F.concat_ws("-", stem, F.substring(F.sha2(key, 256), 1, width))


def preview(text: Column, width: int = 160) -> Column:
    return F.substring(collapse(text), 1, width)


def redact_assignments(text: Column) -> Column:
    """KEY=value secrets inline, without their values."""
    return F.regexp_replace(text, r"(?i)\b([A-Z0-9_]*(?:API_KEY|TOKEN|SECRET|PASSWORD)[A-Z0-9_]*)\s*=\s*\S+", "$1=[REDACTED]")


def host(address: Column) -> Column:
    """The host of host:port or [host]:port."""
    return F.coalesce(F.nullif(F.regexp_extract(address, r"^\[(.*)\](?::[^:]*)?$", 1), F.lit("")), F.regexp_extract(address, r"^(.*?)(?::[^:]*)?$", 1))


def port(address: Column) -> Column:
    return F.try_to_number(F.regexp_extract(address, r":(\d+)$", 1), F.lit("99999")).cast("int")


def is_loopback(address: Column) -> Column:
    h = F.lower(host(address))
    return h.rlike(r"^127(?:\.\d{1,3}){3}$") | h.isin("::1", "localhost", "0:0:0:0:0:0:0:1")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Place (from 0) of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def finite(value: Column, otherwise: float = 0.0) -> Column:
    """A text or number as a finite double."""
    x = value.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(otherwise)).otherwise(x)
