"""logquarry.operators"""
