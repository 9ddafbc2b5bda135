"""Schemas of the register, its events and its orders."""

from __future__ import annotations

LEAD_EXTRA = (
    "struct<whyNowDate:date,rawPhone:string,requirement:string,quantity:string,deadline:date,contact_name:string,contact_phone:string,contact_email:string,"
    "document_url:string,quantityKg:double,quantityKgPerDay:double,quantityFit:string,lat:double,lon:double,commodity:string,market:string,minPrice:double,"
    "maxPrice:double,modalPrice:double,arrivalDate:string,mergedFrom:array<string>,sources:array<string>>"
)
LEAD = (
    "id string, kind string, segment string, segment_source string, segment_model string, opener_model string, name string, city string, state string, address string, phone string, "
    "email string, website string, why_now string, source string, source_url string, licence string, first_seen timestamp, last_seen timestamp, score int, status string, notes string, "
    f"extra {LEAD_EXTRA}"
)
CANDIDATE = "source string, external_id string, kind string, segment string, name string, city string, state string, address string, phone string, email string, website string, why_now string, why_now_date date, source_url string, licence string"
EVENT = "run_id string, seq int, type string, at timestamp, key string, role string, payload string"
ORDER = (
    "id string, event_id string, received_at timestamp, created_at timestamp, status string, contact_name string, business_name string, phone string, email string, city string, "
    "business_type string, products array<string>, order_details string, schedule string, needed_by date, notes string, source_path string"
)
PRICE = "commodity string, variety string, market string, district string, state string, date date, min_price double, max_price double, modal_price double"
