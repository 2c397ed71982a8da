"""The analyses: quality reports, tiers, annual means, traffic, profiles and map layers."""
