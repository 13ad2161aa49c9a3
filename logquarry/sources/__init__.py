"""logquarry.sources"""
