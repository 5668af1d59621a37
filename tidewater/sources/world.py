"""The simulated shop. Names, shares, ranges and weights of the domain."""

from typing import NamedTuple


class Sku(NamedTuple):
    category: str
    price: float


class Tier(NamedTuple):
    share: float
    conversion: float
    order_value: float


class Device(NamedTuple):
    share: float
    conversion: float
    buffers: bool


class Persona(NamedTuple):
    weight: float
    pages: tuple[int, int]
    seconds: tuple[float, float]
    intent: float
    close: float


def _named(kind, table: dict) -> dict:
    return {k: kind(*v) for k, v in table.items()}


SKUS = _named(Sku, {
    "MG-1001": ("household", 28.98), "MG-1002": ("household", 32.44), "MG-1003": ("household", 24.12), "MG-2001": ("pantry", 36.80), "MG-2002": ("pantry", 21.50),
    "MG-2003": ("pantry", 44.99), "MG-2004": ("pantry", 17.25), "MG-3001": ("fresh", 6.99), "MG-3002": ("fresh", 11.40), "MG-3003": ("fresh", 89.00),
    "MG-4001": ("electronics", 549.00), "MG-4002": ("electronics", 289.99), "MG-4003": ("electronics", 99.00), "MG-5001": ("outdoor", 179.00), "MG-5002": ("outdoor", 399.00),
    "MG-6001": ("pharmacy", 22.75), "MG-6002": ("pharmacy", 19.99), "MG-6003": ("pharmacy", 14.50),
})
CATEGORIES = ("electronics", "fresh", "household", "outdoor", "pantry", "pharmacy")
TIERS = _named(Tier, {"guest": (0.42, 0.35, 0.7), "basic": (0.38, 1.00, 1.0), "plus": (0.20, 1.85, 1.6)})
DEVICES = _named(Device, {"mobile_web": (0.44, 0.62, False), "desktop": (0.27, 1.55, False), "app": (0.24, 1.30, True), "tablet": (0.05, 0.95, False)})
PERSONAS = _named(Persona, {
    "bouncer": (0.34, (1, 2), (1.0, 9.0), 0.00, 0.00),
    "browser": (0.29, (3, 9), (3.0, 45.0), 0.06, 0.30),
    "researcher": (0.13, (8, 26), (10.0, 120.0), 0.22, 0.35),
    "buyer": (0.08, (3, 11), (2.0, 30.0), 0.78, 0.72),
    "restocker": (0.03, (2, 5), (0.5, 7.0), 0.88, 0.90),
    "checker": (0.07, (6, 22), (0.7, 4.2), 0.03, 0.40),
    "bot": (0.06, (12, 80), (0.05, 2.6), 0.00, 0.00),
})
HOURS = (0.28, 0.18, 0.13, 0.11, 0.13, 0.22, 0.44, 0.71, 0.88, 0.96, 1.00, 1.05, 1.12, 1.02, 0.94, 0.92, 0.97, 1.15, 1.38, 1.52, 1.47, 1.21, 0.83, 0.48)
WEEKDAYS = (0.94, 0.91, 0.93, 0.98, 1.06, 1.14, 1.22)
LANDING = {"home": 0.30, "search": 0.24, "category": 0.18, "product": 0.28}
SEARCHES = (
    "paper towels", "papertowls", "toilet paper", "tp", "olive oil", "rice", "coffee", "ribeye", "tv", "65 inch tv", "vacuum", "robot vac", "grill", "propane",
    "vitamins", "allergy", "reading glasses", "strawberries", "chicken", "bulk", "deals", "what time does my club close", "returns", "cheap", "sale", "asdfgh", "gift card balance",
)
SCHEMA_VERSION, DRIFTED_VERSION = "2.3.0", "2.4.0"
RETURNING, MEMBER = 0.35, 0.82
