"""One frozen object for everything that differs between deployments.

Its values become literals in the plans, so Catalyst can fold them. Nothing in
the package reads a clock: "now" always arrives as the argument ``as_of``.
"""
from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    site_name: str = "Town Listings"
    short_name: str = "TownListings"
    site_url: str = "https://listings.example.org"
    region: str = "Bay Area"
    zone: str = "America/Los_Angeles"
    state: str = "CA"
    default_city: str = "San Francisco"
    cities: tuple[str, ...] = ("San Francisco", "Oakland", "San Jose", "Berkeley")
    map_center: tuple[float, float] | None = (-122.27, 37.80)   # lng, lat
    region_radius_km: float = 150.0
    family_venues: tuple[str, ...] = ()
    editors_picks: bool = True

    @property
    def ics_domain(self) -> str:
        host = self.site_url.split("://", 1)[-1].split("/", 1)[0].split(":", 1)[0]
        return host or f"{self.short_name.lower()}.invalid"


DEFAULT = Settings()
