"""Jobs over tables of companies, filings, facts and records."""
