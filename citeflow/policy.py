"""Vocabularies and weights of the rule engines. Every number that a rule uses is here."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib

RECHECK_DAYS = {"blocked_by_robots": 180, "dns_failure": 7, "for_sale": 7, "hard_404": 30, "live": 90, "parked": 7, "redirect": 90, "soft_404": 30, "tls_failure": 14, "unregistered": 3}
RECHECK_DEFAULT_DAYS, TRANSIENT_SECONDS, TRANSIENT_CAP, TRANSIENT_AFTER = 30, 3600, 86_400, 7 * 86_400
HARD_CAP_DAYS, CONFIRMATIONS, LOOK_BACK, BREAKER = 180, 3, 20, 5
DOMAIN_DAYS = {"active": 90, "expiring": 1, "for_sale": 7, "no_rdap_for_tld": 30, "parked": 7, "unknown": 7, "unregistered": 3}
EXPIRY_WATCH_DAYS, EXPIRY_RECHECK_DAYS = 60, 3
STATE_POINTS = {"unregistered": 50, "expiring": 35, "for_sale": 30, "parked": 20, "no_rdap_for_tld": 5, "unknown": 3, "active": 0}
#: In this order the first that a site has counts.
DEATH_POINTS = {"dns_failure": 6, "unregistered": 6, "for_sale": 5, "parked": 4, "tls_failure": 3, "soft_404": 2, "hard_404": 2}
KIND_POINTS = {"citation": 8, "external_links_section": 5, "further_reading": 4}
PAGE_POINTS, PAGE_CAP, DEAD_TAG_POINTS, REMOVAL_POINTS, PRIVATE_SUFFIX_POINTS = 3, 30, 5, 7, -15
INTERESTING = ("dns_failure", "for_sale", "hard_404", "parked", "soft_404", "tls_failure")
FAILURES = ("dns_failure", "temporarily_unavailable", "tls_failure")
THIN_BODY = 512
SECRET_NAMES = ("_KEY", "_PASSWORD", "_SECRET", "_TOKEN")
#: Verdict and confidence of each kind of transport error; a kind that is not listed is unclassified at 0.3.
ERROR_KINDS = (
    {k: ("dns_failure", 1.0) for k in ("dns_error", "dns_nxdomain")}
    | {f"tls_{k}": ("tls_failure", 1.0) for k in ("cert_expired", "chain_untrusted", "error", "hostname_mismatch")}
    | {k: ("temporarily_unavailable", 0.9) for k in ("connect_error", "connect_timeout", "connection_refused", "pool_timeout", "protocol_error", "read_error", "read_timeout", "timeout")}
    | {k: ("unclassified", 0.5) for k in ("blocked_address", "no_host", "redirect_loop", "too_many_redirects", "unsupported_protocol")}
)
DOMAIN_DEFAULT_DAYS, STALL_SECONDS = 30, 90
#: Rows that an eviction orders in one task.
ORDERED_ROWS = 100_000

PARKING_PROVIDERS = sorted("above.com/park afternic.com bodis.com cashparking.com dan.com domainparkingserver hugedomains.com namebright.com parked-content.godaddy.com parkingcrew.net parklogic.com sav.com/park sedo.com/search/ sedoparking.com undeveloped.com voodoo.com".split())
PARKING_PHRASES = sorted(["parked free, courtesy of", "domain parking service", "this domain is parked", "the domain has been registered", "this domain name is parked", "this page is provided courtesy of", "this webpage was generated by the domain owner"])
PARKING_WEAK = sorted(["related links", "search ads", "related searches", "sponsored listings"])
SALE_PHRASES = sorted(["buy this domain", "domain is available for purchase", "inquire about this domain", "interested in this domain", "make an offer on this domain", "purchase this domain", "the domain name is for sale", "this domain is for sale", "this domain may be for sale", "this domain name is for sale"])
SOFT_PHRASES = sorted(["404 error", "content not found", "error 404", "file not found", "http 404", "no longer available", "nothing found", "page cannot be found", "page could not be found", "page does not exist", "page doesn't exist", "page not found", "sorry, this page", "sorry, we couldn't find", "the requested url was not found", "this page has moved", "we can't find the page"])
SOFT_TITLES = ["404", "not found", "page missing", "page removed", "page unavailable"]
TRACKING = sorted("utm_campaign utm_brand utm_content utm_id utm_medium utm_name utm_place utm_pubreferrer utm_reader utm_social utm_social-type utm_source utm_swu utm_term _ga _gl _hsenc _hsmi dclid fbclid gbraid gclid gclsrc igsh igshid li_fat_id mc_cid mc_eid mkt_tok msclkid oly_anon_id oly_enc_id s_cid sc_campaign sc_channel trk ttclid twclid vero_conv vero_id wbraid yclid".split())
WIKI_SITES = sorted("mediawiki.org toolforge.org wikibooks.org wikidata.org wikimedia.de wikimedia.org wikimediafoundation.org wikinews.org wikipedia.org wikiquote.org wikisource.org wikiversity.org wikivoyage.org wiktionary.org wmcloud.org wmflabs.org".split())
RESOLVERS = sorted("doi.org handle.net identifiers.org isni.org n2t.net openurl.ac.uk purl.org viaf.org worldcat.org".split())
WAYBACK = ["web.archive.org", "web.archive.org.wstub.archive.org"]
ARCHIVE_TODAY = [f"archive.{x}" for x in ("ec", "fo", "is", "li", "md", "ph", "today", "vn")]
EXPIRING_STATUSES = ["client hold", "clienthold", "pending delete", "pendingdelete", "redemption period", "redemptionperiod", "server hold", "serverhold"]
NAMESPACES = sorted([n + t for n in ("Book", "Category", "Draft", "File", "Help", "Image", "MediaWiki", "Module", "Portal", "Template", "TimedText", "User", "Wikipedia") for t in ("", " talk")] + ["Media", "Special", "Talk"])
#: A documented subset of the public suffix list: rule -> private section. *. is a wildcard, ! an exception.
SUFFIXES = {s: False for s in "com net org edu gov mil int info biz io co uk de fr es it nl pl eu us ca au jp cn br in ru ch at be se no dk fi cz pt gr ie nz za mx ar kr tv me cc ai app dev xyz online site co.uk org.uk ac.uk gov.uk me.uk com.au net.au org.au edu.au gov.au co.nz org.nz co.jp ac.jp ne.jp or.jp com.br org.br gov.br com.cn org.cn co.in org.in ac.in com.mx com.ar co.kr co.za com.pl org.pl edu.pl *.ck !www.ck".split()} | {s: True for s in "blogspot.com github.io gitlab.io herokuapp.com netlify.app pages.dev web.app wordpress.com poznan.pl azurewebsites.net cloudfront.net s3.amazonaws.com".split()}


def defaults() -> dict:
    return {k: v for k, v in globals().items() if k.isupper()}


def load(file: str | None = None, env: dict[str, str] | None = None, given: dict | None = None) -> dict:
    """The constants above as they are set: by what is given, else by CITEFLOW_<NAME> of env (JSON), else by the file (TOML; names in
    any case), else as above. A table replaces the one that it sets, and is not merged with it. An unknown name or another kind of value is an error.
    """
    told: dict = {}
    if file is not None and os.path.isfile(file):
        with open(file, "rb") as f:
            told |= {k.upper(): v for k, v in tomllib.load(f).items()}
    told |= {k.removeprefix("CITEFLOW_"): json.loads(v) for k, v in (env or {}).items() if k.startswith("CITEFLOW_") and k.removeprefix("CITEFLOW_") in defaults()}
    told |= {k.upper(): v for k, v in (given or {}).items() if v is not None}
    base = defaults()
    for k, v in told.items():
        if k not in base:
            raise ValueError(f"unknown setting {k}")
        kind = (int, float) if isinstance(base[k], (int, float)) else (list, tuple) if isinstance(base[k], (list, tuple)) else type(base[k])
        if not isinstance(v, kind) or isinstance(v, bool) != isinstance(base[k], bool):
            raise ValueError(f"{k} must be of the kind of {type(base[k]).__name__}")
    return base | told


def fingerprint(settings: dict | None = None) -> str:
    """Version of the classifier with this policy: 1+ and a digest of every constant above, or of what load() gave."""
    held = defaults() if settings is None else settings
    return "1+" + hashlib.sha256(json.dumps(held, sort_keys=True).encode()).hexdigest()[:12]
