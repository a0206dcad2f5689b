"""Column roles and recode tables that the dataflows are parameterised by."""

from __future__ import annotations

from dataclasses import dataclass, field

from regiotally.functions.labels import age_column
from regiotally.operators.reshape import Split


@dataclass(frozen=True)
class Incidents:
    """Roles of the columns of an incident table once it is cleaned."""

    year: str = "year"
    quarter: str = "quarter"
    month: str = "month"
    region: str = "region"
    category: str = "category"
    kind: str = "kind"
    flags: tuple[str, ...] = ()
    count: str = "incidents"

    @property
    def dimensions(self) -> list[str]:
        return [self.year, self.quarter, self.month, self.region, self.category, self.kind, *self.flags]

    @property
    def cell(self) -> list[str]:
        return [self.year, self.quarter, self.region]


@dataclass(frozen=True)
class RegionRecode:
    balance: str
    areas: dict[str, str]
    regions: dict[str, str]
    fallback: str


@dataclass(frozen=True)
class Panel:
    """Names in the monthly panel, and what is counted in it."""

    category: str
    target: str = "incidents"
    flags: tuple[tuple[str, str], ...] = ()
    supply: tuple[str, str] = ("supply", "supply")
    population: str = "total_population"
    extra: tuple[str, ...] = ()
    rate: str = "rate_100k"
    log_rate: str = "log_rate"
    per_head: str = "supply_per_head"
    lag_prefix: str = "rate_lag"
    dummy_prefix: str = "reg_"
    levels: tuple[str, ...] = ()
    reference: str = ""
    variant_levels: tuple[str, ...] = ()

    @property
    def lags(self) -> list[str]:
        return [f"{self.lag_prefix}1", f"{self.lag_prefix}3"]

    @property
    def variants(self) -> dict[str, list[str]]:
        """Four nested feature sets, each adding a group to the one before."""
        timing = ["sin_month", "cos_month", *self.lags]
        supply = [*timing, self.per_head]
        context = [*supply, *[alias for _, alias in self.flags]]
        return {
            "V1: Temporal only": timing,
            "V2: + Supply": supply,
            "V3: + Context": context,
            "V4: + Region": [*context, *[f"{self.dummy_prefix}{v}" for v in self.variant_levels]],
        }


@dataclass(frozen=True)
class Study:
    """Everything the dataflows need to know about one set of sources."""

    incidents: Incidents
    recode: RegionRecode
    flag_codes: dict[str, int]
    supply_regions: dict[str, str]
    population_splits: tuple[Split, ...]
    total_population: str
    split_prefix: str
    measures: tuple[str, ...]
    regions: tuple[str, ...]
    reference: str
    region_prefix: str
    panel: Panel
    unknown_region: str = "Unknown"
    partial_year: int = 0
    alphas: tuple[float, ...] = field(default=(0.01, 0.1, 1.0, 10.0, 100.0))
    folds: int = 5


# Fixed values of the territory sources: sub-areas, police regions and population regions.
SUB_AREAS = {
    "Barkly": "Barkly",
    "Sandover - Plenty": "Barkly",
    "Elsey": "Big Rivers",
    "Gulf": "Big Rivers",
    "Victoria River": "Big Rivers",
    "Petermann - Simpson": "Central Australia",
    "Tanami": "Central Australia",
    "Yuendumu - Anmatjere": "Central Australia",
    "East Arnhem": "East Arnhem",
    "Anindilyakwa": "East Arnhem",
    "Alligator": "Top End",
    "West Arnhem": "Top End",
    "Thamarrurr": "Top End",
    "Tiwi Islands": "Top End",
    "Daly": "Top End",
    "Howard Springs": "Greater Darwin",
    "Humpty Doo": "Greater Darwin",
    "Koolpinyah": "Greater Darwin",
    "Virginia": "Greater Darwin",
    "Weddell": "Greater Darwin",
}
POLICE_REGIONS = {
    "Darwin": "Greater Darwin",
    "Palmerston": "Greater Darwin",
    "Alice Springs": "Central Australia",
    "Katherine": "Big Rivers",
    "Nhulunbuy": "East Arnhem",
    "Tennant Creek": "Barkly",
    "NT Balance": "Top End",
}
POPULATION_REGIONS = ("Greater Darwin", "Central Australia", "Big Rivers", "East Arnhem", "Barkly", "Top End")
INVOLVEMENT = {"Yes": 1, "No": 0, "-": 0}


def territory_study(age_groups, measures=("Total PAC",)) -> Study:
    """The study of the territory's published crime, population and alcohol supply tables.

    ``age_groups`` and ``measures`` are the levels and columns the files at hand contain.
    """
    return Study(
        incidents=Incidents(
            year="Year", quarter="Quarter", month="Month number", region="Region",
            category="Offence category", kind="Offence type",
            flags=("Alcohol involvement", "DV involvement"), count="Number of offences",
        ),
        recode=RegionRecode("NT Balance", SUB_AREAS, POLICE_REGIONS, "Top End"),
        flag_codes=INVOLVEMENT,
        supply_regions=POLICE_REGIONS,
        population_splits=(
            Split("Aboriginal status", ("Aboriginal", "Non-Aboriginal")),
            Split("Sex", ("Male", "Female")),
            Split("Age Group", tuple(age_groups), age_column),
        ),
        total_population="Total_population",
        split_prefix="Pop_age_",
        measures=tuple(measures),
        regions=POPULATION_REGIONS,
        reference="Greater Darwin",
        region_prefix="Region_",
        panel=Panel(
            category="02 Assault", target="Assault_offences",
            flags=(("Alcohol involvement", "Alcohol_involved"), ("DV involvement", "DV_involved")),
            supply=("Total PAC", "Total_PAC"), population="Total_population", extra=("Aboriginal",),
            rate="Assault_rate_100k", log_rate="log_assault_rate", per_head="alcohol_per_capita",
            lag_prefix="assault_rate_lag", dummy_prefix="Reg_",
            levels=POPULATION_REGIONS, reference="Greater Darwin",
            variant_levels=("Barkly", "Central Australia", "East Arnhem"),
        ),
        partial_year=2023,
    )
