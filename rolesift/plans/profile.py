"""The sample profile: vocabularies with weights, title bonuses, marks, bands and limits. Another profile is another set of these values."""

from __future__ import annotations

from rolesift.operators.relevance import Mark, Vocabulary

# Terms and their weights.
ENABLEMENT = {
    "ai enablement": 6.0, "ai adoption": 5.0, "ai transformation": 4.5, "ai strategy": 4.5, "marketing ai": 5.5, "ai for marketing": 5.5, "gtm ai": 5.0, "ai operations": 4.0,
    "agentic": 5.0, "ai agent": 4.0, "ai workflow": 4.0, "ai native": 3.0, "ai literacy": 4.0, "ai champion": 4.0, "ai upskilling": 5.0, "upskill": 3.0, "enablement": 2.0,
    "power user": 3.5, "ai tooling": 3.0, "ai use case": 3.0, "artificial intelligence": 1.5, "generative ai": 3.0, "genai": 3.0, "ai roadmap": 4.5, "ai vision": 4.0,
    "ai council": 4.0, "ai opportunities": 3.5, "agent-powered": 4.5, "ai-powered workflow": 4.0, "internal ai": 3.5, "automate workflows": 3.0, "automating workflows": 3.0,
    "ai architect": 3.0, "applied ai": 3.0, "ai deployment": 2.5, "ai implementation": 2.5,
}
MARKETING = {
    "marketing": 3.0, "go-to-market": 3.0, "go to market": 3.0, "gtm": 2.5, "demand generation": 3.0, "demand gen": 3.0, "growth marketing": 3.0, "product marketing": 2.5,
    "brand": 1.5, "campaign": 2.0, "lifecycle marketing": 2.5, "marketing operations": 3.5, "marketing ops": 3.5, "mops": 2.5, "content marketing": 2.0, "seo": 1.5, "crm": 1.5,
    "marketo": 2.0, "hubspot": 1.5, "salesforce": 1.0, "sales enablement": 2.0, "funnel": 1.5, "pipeline": 1.0, "marketing enablement": 3.5, "gtm enablement": 3.0,
    "go-to-market enablement": 3.0,
}
ENTERPRISE = {
    "company-wide": 3.0, "companywide": 3.0, "organization-wide": 3.0, "across the organization": 3.0, "across the company": 3.0, "across the business": 2.5, "enterprise ai": 3.0,
    "center of excellence": 3.0, "business functions": 2.5, "every function": 2.5, "all functions": 2.5, "firm-wide": 3.0, "field organization": 2.5, "business units": 2.0,
    "functional teams": 2.0,
}
BUILD = {
    "mcp": 3.0, "llm": 2.5, "prompt": 2.0, "workflow automation": 3.0, "automation": 1.5, "api": 1.0, "integration": 1.0, "no-code": 1.5, "low-code": 1.5, "n8n": 2.5, "zapier": 1.5,
    "orchestration": 2.0, "human-in-the-loop": 3.5, "human in the loop": 3.5,
}
CAPTURE = {
    "conversion rate optimization": 7.0, "conversion optimization": 6.5, "website optimization": 6.5, "web growth": 6.5, "landing page": 6.0, "a/b test": 6.0, "ab test": 5.0,
    "experimentation": 5.5, "cro": 5.0, "conversion rate": 4.5, "lead capture": 5.0, "funnel conversion": 5.0, "on-site": 3.0, "personalization": 3.5, "user experience": 3.0,
    "web analytics": 4.0, "site performance": 3.5, "seo": 4.0, "answer engine": 4.5, "aeo": 4.0,
}
GROWTH = {
    "growth marketing": 5.0, "growth strategy": 4.0, "funnel": 4.0, "customer acquisition": 3.5, "product-led growth": 4.0, "plg": 3.5, "lifecycle marketing": 3.0, "retention": 2.5,
    "activation": 2.5,
}
CREATION = {
    "demand generation": 2.5, "demand gen": 2.5, "paid media": 1.5, "paid acquisition": 1.5, "paid search": 1.5, "paid social": 1.5, "performance marketing": 2.0, "media buying": 1.0,
    "campaign management": 1.0, "programmatic": 1.0, "webinar": 0.5, "field marketing": 1.0, "events": 0.5, "sem": 1.5, "pipeline generation": 2.0, "account-based marketing": 1.5,
    "account based marketing": 1.5,
}
MEASUREMENT = {
    "conversion rate": 3.0, "attribution": 3.0, "analytics": 2.0, "cac": 2.5, "ltv": 2.5, "roas": 2.5, "pipeline": 2.0, "mql": 2.5, "sql": 1.0, "cohort": 2.0, "dashboard": 1.5,
    "marketo": 3.0, "hubspot": 2.5, "salesforce": 2.0, "google analytics": 3.0, "adobe analytics": 3.0, "optimizely": 3.0, "segment": 1.5,
}
TITLES_A = {
    "marketing engineer": 6.0, "marketing technologist": 6.0, "gtm engineer": 5.0, "ai enablement": 6.0, "marketing ai": 6.0, "ai marketing": 6.0, "growth engineer": 3.0,
    "marketing technology": 4.0, "ai operations": 4.0, "ai program": 3.0, "ai transformation": 5.0, "ai strategy": 5.0, "ai adoption": 5.0, "ai solutions": 4.0, "martech": 5.0,
    "ai capabilities": 4.0, "agentic": 4.0,
}
TITLES_B = {
    "growth marketing": 6.0, "demand generation": 6.0, "growth manager": 5.0, "growth lead": 5.0, "performance marketing": 5.0, "lifecycle marketing": 4.5, "web growth": 5.0,
    "acquisition": 4.0, "marketing manager": 2.5, "digital marketing": 3.5,
}
# Patterns of marks, of title tokens and of signals.
EQUIPS = r"\b(equip|enabl|empower|upskill)\w*\s+(our\s+|the\s+|their\s+|your\s+)?(marketers|marketing team|marketing org\w*|marketing organi[sz]ation|gtm team|go-to-market team)"
TEACHES = (
    r"(non.?technical|business users?|citizen developers?)[^.]{0,200}\b(build|create|ship|deploy|run|scale|author)\w*\b[^.]{0,80}(agent|ai|automation|workflow)"
    r"|(agent|ai|automation|workflow)[^.]{0,120}\b(build|create|ship|deploy|run|scale|author)\w*\b[^.]{0,120}(non.?technical|business users?|citizen developers?)"
)
SALES = r"\b(sales organi[sz]ation|sales org|worldwide sales|channel sales|revenue organi[sz]ation|revenue team|sales team|field team|sellers|commercial team|field organi[sz]ation)\b"
TITLE_AI = r"(?:^|[^a-z])(ai|a\.i\.|artificial intelligence|genai|generative ai|agentic|llm)(?:[^a-z]|$)"
TITLE_MARKETING = r"\b(marketing|go.to.market|gtm)\b"
B2B = r"\b(b2b|saas|enterprise|mid-?market|smb|abm|account.based|sales.qualified|pipeline|demand gen|mql|sdr|crm|salesforce|marketo)\b"
B2C = r"\b(b2c|d2c|dtc|direct.to.consumer|e-?commerce|ecommerce|shopify|subscription box|consumer brand|retail|merchandis\w+|shopper)\b"
CREATES = (
    r"\b(paid search|paid social|programmatic|media buying|ad platforms?|campaign management|campaign workflows?|media spend|digital media|budget pacing|multi-?channel budgets?"
    r"|ad formats?|affiliate|influencer|webinars?|field marketing|events? marketing|channel strategy|demand generation|demand gen|integrated campaigns?|account.based marketing|abm)\b"
)
CAPTURES = (
    r"\b(conversion rate optimi[sz]ation|website optimi[sz]ation|landing page|a/b test|ab test|experimentation|web growth|on-?site experience|funnel conversion|lead capture"
    r"|site performance|answer engine|web pages?|webpages?|website conversion|organic search|\bseo\b|conversion flow|conversion logic|website analytics)\b"
)
CREATES_TITLE = r"\b(demand gen\w*|performance marketing|paid|media|campaign|field marketing|acquisition marketing|events?)\b"
CAPTURES_TITLE = r"\b(web|website|conversion|optimi[sz]ation|experimentation|cro|seo)\b"
FLUENCY = r"\b(ai.fluen\w+|ai.literate|ai.literacy|comfortable with ai|experience with ai|ai.powered|ai tools|leverage ai|using ai|generative ai|genai|llm|prompt)\b"
SENIOR_TITLE = r"\b(director|head of|head,|vice president|vp|svp|evp|chief)\b"
CLAIMABLE = r"(ai enablement|ai transformation|ai strategy|ai adoption|\bgrowth\b|\bweb\b|website|conversion|\bcro\b)"
SENIORITY_CAP = 3.5
FLOOR_A, FLOOR_B, GROWTH_SHARE = 40.0, 65.0, 1.6

TRACK_A = Vocabulary(
    {"first": ENABLEMENT, "second": MARKETING, "second_too": ENTERPRISE, "build": BUILD},
    TITLES_A,
    marks=(Mark("equips-marketers", EQUIPS, 5.0), Mark("teaches-nontechnical-to-build", TEACHES, 4.5), Mark("sales-context", SALES, 0.0)),
    split_title=("title:ai+marketing", (TITLE_AI, TITLE_MARKETING), 4.0),
)
TRACK_B = Vocabulary({"capture": CAPTURE, "growth": GROWTH, "creation": CREATION, "measurement": MEASUREMENT}, TITLES_B)
#: Names that stand for either side of track A, and for the core of track B.
SIDE_FIRST = (*ENABLEMENT, *(f"title:{t}" for t in TITLES_A), "equips-marketers", "title:ai+marketing", "teaches-nontechnical-to-build")
SIDE_SECOND = (*MARKETING, *ENTERPRISE, "sales-context", *(f"title:{t}" for t in TITLES_A if "marketing" in t), "title:ai+marketing")
CORE_B = (*CAPTURE, *GROWTH, *CREATION, *(f"title:{t}" for t in TITLES_B))
