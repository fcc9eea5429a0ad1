"""Fixed patterns that a site's whole text is searched for, and how they cross from one page to the next."""

from __future__ import annotations

WORD_END, WORD_START = "(?![A-Za-z0-9_])", "(?<![A-Za-z0-9_])"
# What the text of a whole site is searched for.
TEXT_FLAGS = {
    "has_direct_answers": "(?:we are|we provide|we offer|we specialize|our services include|the best way to|how to|what is|how much|how long)",
    "has_process": r"our process|how it works|how we work|step [0-9]|step-by-step|methodology|implementation process",
    "has_pricing": "pricing|plans|price|cost|quote|estimate|subscription|per month|per year",
    "has_author": "author|written by|reviewed by|founder|ceo|owner|expert|team",
    "has_credentials": "certified|licensed|insured|award|partner|accredited|years of experience|ISO|SOC 2|HIPAA|GDPR",
    "has_case_studies": "case study|results|portfolio|customer story|testimonial",
    "ecommerce_words": "cart|checkout|add to cart|shop|shipping|returns|sku|inventory",
    "review_words": "review|rating|stars",
    "has_shipping_returns": "shipping|returns|refund|delivery",
    "likely_saas": "software|platform|SaaS|dashboard|API|integrations|subscription|demo|free trial",
    "has_integrations": "integrations?|connectors?|zapier|slack|salesforce|hubspot",
    "has_security_trust": "security|SOC 2|ISO 27001|SSO|SAML|GDPR|HIPAA|privacy",
    "has_address": r"[0-9]+[ \n]+[a-z0-9 .'-]+(?:street|st|avenue|ave|road|rd|drive|dr|boulevard|blvd|lane|ln|suite|ste)" + WORD_END,
    "has_hours": r"hours|open monday|mon(?:day)?[ \n]*-|24/7|open 24",
    "has_service_area": "service area|serving|nearby|surrounding areas|local",
}
# Of patterns whose white space may hold a line end, what stands before and after it.
SEAMS = {
    "has_address": ("[0-9]", r"[a-z0-9 .'-]+(?:street|st|avenue|ave|road|rd|drive|dr|boulevard|blvd|lane|ln|suite|ste)" + WORD_END),
    "has_hours": ("mon(?:day)?", "-"),
}


def freshness(year: int) -> str:
    return f"updated|last updated|{WORD_START}{year - 1}{WORD_END}|{WORD_START}{year}{WORD_END}|current|latest|recent"
