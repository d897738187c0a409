"""The rules in Python's regex dialect, for comparison with Spark's results.

Fixed values: the patterns must match what the rules are defined to match.
"""

import re

I = re.IGNORECASE
PLAIN = {
    "fio": re.compile(r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?\b"),
    "phone": re.compile(
        r"(?:\+7|8|7)?[\s\-]?\(?[489]\d{2}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b"
    ),
    "email": re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    "passport": re.compile(
        r"\b(?:паспорт|серия)?[\s:]*\d{2}[\s\-]?\d{2}[\s\-№]+\d{6}\b", I
    ),
    "snils": re.compile(r"\b\d{3}[\-\s]?\d{3}[\-\s]?\d{3}[\-\s]?\d{2}\b"),
    "inn": re.compile(r"\b(?:инн[\s:№]*)?(?:\d{10}|\d{12})\b", I),
    "driver_license": re.compile(r"\b\d{2}\s?\d{2}\s?\d{6}\b"),
    "bank_card": re.compile(r"\b(?:\d{4}[\s\-]?){3}\d{4}\b"),
    "bank_account": re.compile(r"\b\d{20}\b"),
    "bik": re.compile(r"\b(?:бик[\s:№]*)?04\d{7}\b", I),
    "birth_date": re.compile(
        r"\b(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[012])[./-](?:19|20)\d{2}\b"
    ),
    "address": re.compile(
        r"(?:г\.|город|ул\.|улица|пр\.|проспект|д\.|дом)[\s.]+[А-ЯЁа-яё0-9\s\-,.]+", I
    ),
    "biometric": re.compile(
        r"\b(?:отпечат(?:ок|ки)\s+пальц|радужн(?:ая|ой)\s+оболочк|голосов(?:ой|ые)\s+образ|"
        r"биометр|сканирование\s+лиц|распознавание\s+лиц)\w*\b",
        I,
    ),
    "health": re.compile(
        r"\b(?:диагноз|заболевание|болезнь|лечение|медицинск|анализ|обследование|терапия|"
        r"операция|инвалидность|группа\s+здоровья)\w*\b",
        I,
    ),
    "special": re.compile(
        r"\b(?:религ|вероисповедание|национальность|раса|"
        r"политическ(?:ие|ая)\s+(?:взгляд|убеждени)|профсоюз|интимн)\w*\b",
        I,
    ),
}


def plain_matches(text: str) -> set[tuple[str, int, str]]:
    return {
        (category, m.start(), m.group(0))
        for category, pattern in PLAIN.items()
        for m in pattern.finditer(text)
    }
