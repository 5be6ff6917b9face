"""De-identification techniques, risk measures and parameter searches."""
