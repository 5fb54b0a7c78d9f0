"""Set-wise operators over requests, links, candidates and cells."""
