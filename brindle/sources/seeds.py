"""Seed dimensions of the taxonomy, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (slug, label, order) of the verticals, (slug, vertical, label, order) of the clusters.
VERTICALS = (
    ("vehicle", "Vehicle", 10), ("tourism", "Tourism", 20), ("beauty", "Beauty", 30), ("health", "Health", 40), ("food", "Food", 50), ("fitness", "Fitness", 60),
    ("real_estate", "Real Estate", 70), ("education", "Education", 80), ("legal", "Legal", 90), ("retail", "Retail", 100), ("home_services", "Home Services", 110),
)
CLUSTERS = (
    ("vehicle_rentals", "vehicle", "Vehicle Rentals", 10), ("vehicle_leasing", "vehicle", "Vehicle Leasing", 20), ("tour_operators", "tourism", "Tour Operators", 10),
    ("tourism_activities", "tourism", "Tourism Activities", 20), ("beauty_services", "beauty", "Beauty Services", 10), ("beauty_clinics", "beauty", "Beauty Clinics", 20),
    ("wellness_clinics", "health", "Wellness Clinics", 10), ("food_service", "food", "Food Service", 10), ("fitness_studios", "fitness", "Fitness Studios", 10),
    ("property_agencies", "real_estate", "Property Agencies", 10), ("training_centers", "education", "Training Centers", 10), ("law_firms", "legal", "Law Firms", 10),
    ("specialty_retail", "retail", "Specialty Retail", 10), ("property_services", "home_services", "Property Services", 10),
)


def verticals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VERTICALS), "slug string, label string, sort_order int")


def clusters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLUSTERS), "slug string, vertical string, label string, sort_order int")
