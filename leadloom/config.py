"""The client profile: what the rules of scoring, ranking and matching are parametrised by."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Points of the rules.
SEGMENT_POINTS = {"wholesale": 30, "hotel": 30, "restaurant": 30, "food_manufacturer": 30, "distributor": 26, "caterer": 22, "retailer": 18, "institution": 16, "other": 8}
SIZE_POINTS = {"large": 6, "medium": 2, "small": -4, "unknown": 0}
CONTACT_POINTS = {"phone": 30, "email": 20, "website": 10, "none": 0}
RECENCY_POINTS = {"within14": 20, "within30": 10, "older": 0, "unknown": 4}
DEADLINE_POINTS = {"closed": 0, "within7": 30, "within14": 25, "within30": 18, "later": 10, "none": 8}
FIT_POINTS = {"within": 25, "unstated": 12, "small": 8, "over": 6}
REQUIREMENT_CONTACT_POINTS = {"phone_and_email": 30, "phone": 26, "email": 18, "name_only": 6, "none": 0}
PLACE_POINTS = {"city": 15, "state": 8, "elsewhere": 0}
CITY_MATCH, ADDRESS, LOCATION, CONTACTED_PENALTY = 10, 5, 5, 25
MODEL_CONFIDENCE = 0.7
STATUSES = ("new", "contacted", "quoted", "won", "lost", "ignored")


@dataclass(frozen=True)
class Profile:
    city: str
    state: str | None = None
    exclude: tuple[str, ...] = ()
    produce_words: tuple[str, ...] = ("vegetables", "fruits", "groceries", "garlic", "onion", "potato", "tomato")
    requirement_words: tuple[str, ...] = ("tender", "rfq", "eoi", "bids", "supply of", "empanelment", "quotation")
    opening_words: tuple[str, ...] = ("open", "opens", "opening", "launch", "launches", "expansion")
    venue_words: tuple[str, ...] = ("hotel", "restaurant", "canteen", "mall", "kitchen")
    demand_gap: int = 140
    opening_gap: int = 90
    kg_per_day: tuple[float, float] = (25.0, 3000.0)
    headline_kg_per_day: float = 1000.0
    section_caps: dict[str, int] = field(default_factory=lambda: {"requirement": 5, "buyer": 5, "registration": 3})
    per_source_share: float = 0.2
