"""Daily totals kept up to date while hourly files arrive."""
