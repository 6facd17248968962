"""Curated dimensions: topics, their roster, sources, channels, labels, prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values -----------------------------------------------------------
ALL = "all"
TOPIC_KEYS = ("all", "iran-us", "ukraine-russia", "china-taiwan")
SNAPSHOT_BASES = (
    "firecrawl-news",
    "analyst-curated",
    "perplexity-osint",
    "telegram-feed",
    "ai-summarize",
    "bias-tracker",
)
AUDITED_BASES = SNAPSHOT_BASES[:5]
CHANNEL_BASE = "telegram-feed"
UNSUFFIXED_LEGACY_KEYS = ("bias-tracker",)

# key, search terms, label, region, left / right / center stance label, timeline start
TOPICS = (
    (
        "iran-us",
        "Iran, US, Israel, Middle East conflict, Strait of Hormuz, Gulf security, IRGC, Hezbollah, "
        "Iranian nuclear program, US sanctions Iran",
        "Iran / U.S.", "Middle East",
        "U.S. / Israel", "Iran", "Neutral / International", "2026-02-28",
    ),
    (
        "ukraine-russia",
        "Ukraine, Russia, Donbas, Crimea, NATO, Zelensky, Putin, Black Sea, Ukrainian counteroffensive, "
        "Russian invasion",
        "Ukraine / Russia", "Eastern Europe",
        "Ukraine / West", "Russia", "Neutral / International", "2022-02-24",
    ),
    (
        "china-taiwan",
        "China, Taiwan, South China Sea, Xi Jinping, Taiwan Strait, PLA, AUKUS, Indo-Pacific, "
        "Chinese military, semiconductor",
        "China / Taiwan", "Indo-Pacific",
        "Taiwan / West", "China", "Neutral / International", "2024-01-01",
    ),
)
ALL_LABELS = {
    "label": "All Conflicts (Iran/U.S., Ukraine/Russia, China/Taiwan)",
    "region": "Global (Middle East, Eastern Europe, Indo-Pacific)",
    "left_label": "Western / U.S.-aligned",
    "right_label": "Anti-Western / Adversary-aligned",
    "center_label": "Neutral / International",
}
# topic, source URL in order
TOPIC_SOURCES = (
    ("iran-us", "https://www.reuters.com/world/middle-east/"),
    ("iran-us", "https://www.bbc.com/news/world/middle_east"),
    ("iran-us", "https://www.aljazeera.com/middle-east/"),
    ("iran-us", "https://apnews.com/hub/middle-east"),
    ("ukraine-russia", "https://www.reuters.com/world/europe/"),
    ("ukraine-russia", "https://www.bbc.com/news/world/europe"),
    ("ukraine-russia", "https://apnews.com/hub/russia-ukraine"),
    ("ukraine-russia", "https://www.aljazeera.com/europe/"),
    ("china-taiwan", "https://www.reuters.com/world/asia-pacific/"),
    ("china-taiwan", "https://www.bbc.com/news/world/asia"),
    ("china-taiwan", "https://apnews.com/hub/asia-pacific"),
    ("china-taiwan", "https://www.aljazeera.com/asia-pacific/"),
)
# topic, name, title, kind; order decides which person a partial name resolves to
ROSTER = (
    ("iran-us", "Rafael Grossi", "Director General, IAEA", "official"),
    ("iran-us", "Abbas Araghchi", "Foreign Minister, Iran", "official"),
    ("iran-us", "Marco Rubio", "U.S. Secretary of State", "official"),
    ("iran-us", "Esmail Baghaei", "Spokesperson, Iranian Foreign Ministry", "official"),
    ("iran-us", "Antonio Guterres", "Secretary-General, United Nations", "official"),
    ("iran-us", "Ali Vaez", "Iran Project Director, International Crisis Group", "analyst"),
    ("iran-us", "Karim Sadjadpour", "Senior Fellow, Carnegie Endowment for International Peace", "analyst"),
    ("iran-us", "Vali Nasr", "Professor, Johns Hopkins SAIS", "analyst"),
    ("iran-us", "Trita Parsi", "Executive Vice President, Quincy Institute", "analyst"),
    ("iran-us", "Sanam Vakil", "Director, Middle East and North Africa Programme, Chatham House", "analyst"),
    ("ukraine-russia", "Volodymyr Zelensky", "President, Ukraine", "official"),
    ("ukraine-russia", "Vladimir Putin", "President, Russia", "official"),
    ("ukraine-russia", "Mark Rutte", "Secretary General, NATO", "official"),
    ("ukraine-russia", "Sergei Lavrov", "Foreign Minister, Russia", "official"),
    ("ukraine-russia", "Andrii Sybiha", "Foreign Minister, Ukraine", "official"),
    ("ukraine-russia", "Michael Kofman", "Senior Fellow, Carnegie Endowment for International Peace", "analyst"),
    ("ukraine-russia", "Dara Massicot", "Senior Fellow, Carnegie Endowment for International Peace", "analyst"),
    ("ukraine-russia", "Lawrence Freedman", "Emeritus Professor of War Studies, King's College London", "analyst"),
    ("ukraine-russia", "Fiona Hill", "Senior Fellow, Brookings Institution", "analyst"),
    ("ukraine-russia", "Tatiana Stanovaya", "Senior Fellow, Carnegie Russia Eurasia Center", "analyst"),
    ("china-taiwan", "Lai Ching-te", "President, Taiwan", "official"),
    ("china-taiwan", "Xi Jinping", "President, China", "official"),
    ("china-taiwan", "Wang Yi", "Foreign Minister, China", "official"),
    ("china-taiwan", "Lin Chia-lung", "Foreign Minister, Taiwan", "official"),
    ("china-taiwan", "Pete Hegseth", "U.S. Secretary of Defense", "official"),
    ("china-taiwan", "Bonnie Glaser", "Managing Director, Indo-Pacific Program, German Marshall Fund", "analyst"),
    ("china-taiwan", "M. Taylor Fravel", "Professor of Political Science, MIT", "analyst"),
    ("china-taiwan", "Oriana Skylar Mastro", "Center Fellow, Stanford University", "analyst"),
    ("china-taiwan", "Amanda Hsiao", "Director, China, Eurasia Group", "analyst"),
    ("china-taiwan", "Wen-Ti Sung", "Fellow, Atlantic Council Global China Hub", "analyst"),
)
# channel id, short label
CHANNELS = (
    ("middleeasteye", "MEE"),
    ("iranintl", "IranIntl"),
    ("geopolitics_prime", "GeoPrime"),
    ("bricsnews", "BRICS"),
    ("megatron_ron", "Megatron"),
    ("DDGeopolitics", "DDGeo"),
    ("thecradlemedia", "Cradle"),
    ("warmonitors", "WarMon"),
    ("CIG_telegram", "CIG"),
    ("monitor_the_situation", "Monitor"),
    ("ukr_leaks_eng", "UkrLeaks"),
)
# English stance and topic labels with their Arabic display form
LABELS_AR = (
    ("Iran / U.S.", "إيران / الولايات المتحدة"),
    ("Ukraine / Russia", "أوكرانيا / روسيا"),
    ("China / Taiwan", "الصين / تايوان"),
    ("U.S. / Israel", "الولايات المتحدة / إسرائيل"),
    ("Iran", "إيران"),
    ("Neutral / International", "محايد / دولي"),
    ("Ukraine / West", "أوكرانيا / الغرب"),
    ("Russia", "روسيا"),
    ("Taiwan / West", "تايوان / الغرب"),
    ("China", "الصين"),
    ("Western / U.S.-aligned", "الغرب / حلفاء أمريكا"),
    ("Anti-Western / Adversary-aligned", "معادي للغرب / حلفاء الخصوم"),
)
# provider, model tier, USD per call
PRICES = (
    ("firecrawl", "scrape", "0.0015"),
    ("firecrawl", "scrape-v1", "0.0015"),
    ("perplexity", "sonar", "0.005"),
    ("perplexity", "sonar-pro", "0.015"),
    ("google_ai", "gemini-flash", "0.0008"),
    ("google_ai", "google/gemini-2.5-flash", "0.0008"),
)
SOURCES_PER_TOPIC = 4
HEAD_CHARS = {"news": 2000, "topics": 3000}
CHANNEL_TAIL_CHARS = 1500
CORPUS_STYLE = {
    "news": ("SOURCE: ", "\n", "\n\n---\n\n"),
    "topics": ("=== ", " ===\n", "\n\n"),
    "channel": ("@", ":\n", "\n---\n"),
}
ITEM_CAPS = {"news": 8, "osint": 6, "timeline": 15, "messages": 15, "stance": 20}
LATEST_MESSAGES = 20
MINUTE_MS = 60_000
DEFAULT_TTL_MS = 60 * MINUTE_MS
STANCE_TTL_MS = 720 * MINUTE_MS
FORCED_TTL_MS = 5 * MINUTE_MS
NEWEST_POST_MS = 120 * MINUTE_MS
ITEM_EXPIRY_HOURS = 48
SNAPSHOT_EXPIRY_HOURS = 24
PAYLOAD_LIMIT = 50_000
LEAVES_PER_CHUNK = 6
LEAVES_PER_RETRY = 4
STORED_ALERTS = 50
ANNOUNCED_ALERTS = 3
POLL_MINUTES = {"default": 15, "stance": 720}
RECENCY_DAYS = {"stance": 7, "analyst_preferred": 14, "analyst": 31}
SOURCE_DOMAINS = ("bellingcat.com", "janes.com", "twitter.com")
# Subtrees a translator must not touch.
PROTECTED_KEYS = (
    "severity", "confidence", "mode", "conflict", "key", "type", "status",
    "source", "coverage_spectrum",
    "left_label", "center_label", "right_label",
    "biasLeftLabel", "biasRightLabel", "biasCenterLabel",
    "timestamp", "last_updated", "cached_at", "url",
)
FEED_OF_BASE = {
    "firecrawl-news": "news",
    "analyst-curated": "analyst",
    "perplexity-osint": "osint",
    "telegram-feed": "messages",
    "ai-summarize": "topics",
}
# Does a feed keep a refresh that found nothing?
STORE_EMPTY = {"news": True, "analyst": True, "osint": False, "topics": True, "messages": True}
# -----------------------------------------------------------------------------


def topic_config(spark: SparkSession) -> DataFrame:
    """One row per topic, in configured order."""
    rows = [(i, *t) for i, t in enumerate(TOPICS)]
    return spark.createDataFrame(
        rows,
        "ord INT, conflict STRING, search_terms STRING, label STRING, region STRING, left_label STRING, "
        "right_label STRING, center_label STRING, start_date STRING",
    )


def topic_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, i, u) for i, (c, u) in enumerate(TOPIC_SOURCES)], "conflict STRING, pos INT, url STRING"
    )


def topic_roster(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, i, n, t, k) for i, (c, n, t, k) in enumerate(ROSTER)],
        "conflict STRING, ord INT, name STRING, title STRING, kind STRING",
    )


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHANNELS), "channel STRING, channel_label STRING")


def labels_ar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELS_AR), "label_en STRING, label_ar STRING")


def prices(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(list(PRICES), "provider STRING, model STRING, price STRING")
    return df.selectExpr("provider", "model", "CAST(price AS DECIMAL(18,6)) AS unit_price")
