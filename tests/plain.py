"""The column rules of texts and addresses once more, in plain Python."""

import re

from listforge import schemas as S


def clean_text(text):
    return re.sub(r"\s+", " ", text or "").strip()


def url_domain(url):
    found = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", url)
    return found[1] if found else ""


def needs_javascript(text):
    return 0 < len(text) < S.JS_PLACEHOLDER_MAX_LENGTH and "javascript" in text.lower()
