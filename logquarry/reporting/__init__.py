"""logquarry.reporting"""
