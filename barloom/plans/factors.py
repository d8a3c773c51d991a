"""The factor library: fixed formulas, their sets, and how many earlier bars each needs.

Fixed values: the formulas below define the factors and are written as published.
"""

from __future__ import annotations

from barloom.functions.factor import (
    Term, abs_, adv, amount, clip_rank, close, decay_linear, delay, delta, high, high_so_far, log, low, low_so_far, max_, min_, open0, open_, pow_, rank, returns, safe_div, scale, sign,
    signed_power, sqrt, ts_argmax, ts_argmin, ts_corr, ts_cov, ts_max, ts_mean, ts_min, ts_product, ts_rank, ts_returns, ts_std, ts_sum, volume, vwap, where,
)

FACTORS: dict[str, Term] = {
    "alpha_001": rank(ts_argmax(signed_power(where((returns < 0), ts_std(returns, 20), close), 2.0), 5)) - 0.5,
    "alpha_002": -1 * ts_corr(rank(delta(log(volume), 2)), rank(((close - open_) / open_)), 6),
    "alpha_003": -1 * ts_corr(rank(open_), rank(volume), 10),
    "alpha_004": -1 * ts_rank(rank(low), 9),
    "alpha_005": rank((open_ - (ts_sum(vwap, 10) / 10))) * (-1 * abs_(rank((close - vwap)))),
    "alpha_006": -1 * ts_corr(open_, volume, 10),
    "alpha_007": where((adv(20) < volume), ((-1 * ts_rank(abs_(delta(close, 7)), 60)) * sign(delta(close, 7))), (-1 * 1)),
    "alpha_008": -1 * rank(((ts_sum(open_, 5) * ts_sum(returns, 5)) - delay((ts_sum(open_, 5) * ts_sum(returns, 5)), 10))),
    "alpha_009": where((0 < ts_min(delta(close, 1), 5)), delta(close, 1), where((ts_max(delta(close, 1), 5) < 0), delta(close, 1), (-1 * delta(close, 1)))),
    "alpha_010": rank(where((0 < ts_min(delta(close, 1), 4)), delta(close, 1), where((ts_max(delta(close, 1), 4) < 0), delta(close, 1), (-1 * delta(close, 1))))),
    "alpha_011": (rank(ts_max((vwap - close), 3)) + rank(ts_min((vwap - close), 3))) * rank(delta(volume, 3)),
    "alpha_012": sign(delta(volume, 1)) * (-1 * delta(close, 1)),
    "alpha_013": -1 * rank(ts_cov(rank(close), rank(volume), 5)),
    "alpha_014": (-1 * rank(delta(returns, 3))) * ts_corr(open_, volume, 10),
    "alpha_015": -1 * ts_sum(rank(ts_corr(rank(high), rank(volume), 3)), 3),
    "alpha_016": -1 * rank(ts_cov(rank(high), rank(volume), 5)),
    "alpha_017": ((-1 * rank(ts_rank(close, 10))) * rank(delta(delta(close, 1), 1))) * rank(ts_rank((volume / adv(20)), 5)),
    "alpha_018": -1 * rank(((ts_std(abs_((close - open_)), 5) + (close - open_)) + ts_corr(close, open_, 10))),
    "alpha_019": (-1 * sign(((close - delay(close, 7)) + delta(close, 7)))) * (1 + rank((1 + ts_sum(returns, 250)))),
    "alpha_020": ((-1 * rank((open_ - delay(high, 1)))) * rank((open_ - delay(close, 1)))) * rank((open_ - delay(low, 1))),
    "alpha_021": where((((ts_sum(close, 8) / 8) + ts_std(close, 8)) < (ts_sum(close, 2) / 2)), (-1 * 1), where(((ts_sum(close, 2) / 2) < ((ts_sum(close, 8) / 8) - ts_std(close, 8))), 1, where(((1 < (volume / adv(20))) | (volume / adv(20)).equals(1)), 1, (-1 * 1)))),
    "alpha_022": -1 * (delta(ts_corr(high, volume, 5), 5) * rank(ts_std(close, 20))),
    "alpha_023": where(((ts_sum(high, 20) / 20) < high), (-1 * delta(high, 2)), 0),
    "alpha_024": where((((delta((ts_sum(close, 100) / 100), 100) / delay(close, 100)) < 0.05) | (delta((ts_sum(close, 100) / 100), 100) / delay(close, 100)).equals(0.05)), (-1 * (close - ts_min(close, 100))), (-1 * delta(close, 3))),
    "alpha_025": rank(((((-1 * returns) * adv(20)) * vwap) * (high - close))),
    "alpha_026": -1 * ts_max(ts_corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3),
    "alpha_027": where((0.5 < rank((ts_sum(ts_corr(rank(volume), rank(vwap), 6), 2) / 2.0))), (-1 * 1), 1),
    "alpha_028": scale(((ts_corr(adv(20), low, 5) + ((high + low) / 2)) - close)),
    "alpha_029": min_(ts_product(rank(rank(scale(log(ts_sum(ts_min(rank(rank((-1 * rank(delta((close - 1), 5))))), 2), 1))))), 1), 5) + ts_rank(delay((-1 * returns), 6), 5),
    "alpha_030": ((1.0 - rank(((sign((close - delay(close, 1))) + sign((delay(close, 1) - delay(close, 2)))) + sign((delay(close, 2) - delay(close, 3)))))) * ts_sum(volume, 5)) / ts_sum(volume, 20),
    "alpha_031": (rank(rank(rank(decay_linear((-1 * rank(rank(delta(close, 10)))), 10)))) + rank((-1 * delta(close, 3)))) + sign(scale(ts_corr(adv(20), low, 12))),
    "alpha_032": scale(((ts_sum(close, 7) / 7) - close)) + (20 * scale(ts_corr(vwap, delay(close, 5), 230))),
    "alpha_033": rank((-1 * ((1 - (open_ / close))**1))),
    "alpha_034": rank(((1 - rank((ts_std(returns, 2) / ts_std(returns, 5)))) + (1 - rank(delta(close, 1))))),
    "alpha_035": (ts_rank(volume, 32) * (1 - ts_rank(((close + high) - low), 16))) * (1 - ts_rank(returns, 32)),
    "alpha_036": ((((2.21 * rank(ts_corr((close - open_), delay(volume, 1), 15))) + (0.7 * rank((open_ - close)))) + (0.73 * rank(ts_rank(delay((-1 * returns), 6), 5)))) + rank(abs_(ts_corr(vwap, adv(20), 6)))) + (0.6 * rank((((ts_sum(close, 200) / 200) - open_) * (close - open_)))),
    "alpha_037": rank(ts_corr(delay((open_ - close), 1), close, 200)) + rank((open_ - close)),
    "alpha_038": (-1 * rank(ts_rank(close, 10))) * rank((close / open_)),
    "alpha_039": (-1 * rank((delta(close, 7) * (1 - rank(decay_linear((volume / adv(20)), 9)))))) * (1 + rank(ts_sum(returns, 250))),
    "alpha_040": (-1 * rank(ts_std(high, 10))) * ts_corr(high, volume, 10),
    "alpha_041": ((high * low)**0.5) - vwap,
    "alpha_042": rank((vwap - close)) / rank((vwap + close)),
    "alpha_043": ts_rank((volume / adv(20)), 20) * ts_rank((-1 * delta(close, 7)), 8),
    "alpha_044": -1 * ts_corr(high, rank(volume), 5),
    "alpha_045": -1 * ((rank((ts_sum(delay(close, 5), 20) / 20)) * ts_corr(close, volume, 2)) * rank(ts_corr(ts_sum(close, 5), ts_sum(close, 20), 2))),
    "alpha_046": where((0.25 < (((delay(close, 20) - delay(close, 10)) / 10) - ((delay(close, 10) - close) / 10))), (-1 * 1), where(((((delay(close, 20) - delay(close, 10)) / 10) - ((delay(close, 10) - close) / 10)) < 0), 1, ((-1 * 1) * (close - delay(close, 1))))),
    "alpha_047": (((rank((1 / close)) * volume) / adv(20)) * ((high * rank((high - close))) / (ts_sum(high, 5) / 5))) - rank((vwap - delay(vwap, 5))),
    "alpha_049": where(((((delay(close, 20) - delay(close, 10)) / 10) - ((delay(close, 10) - close) / 10)) < (-1 * 0.1)), 1, ((-1 * 1) * (close - delay(close, 1)))),
    "alpha_050": -1 * ts_max(rank(ts_corr(rank(volume), rank(vwap), 5)), 5),
    "alpha_051": where(((((delay(close, 20) - delay(close, 10)) / 10) - ((delay(close, 10) - close) / 10)) < (-1 * 0.05)), 1, ((-1 * 1) * (close - delay(close, 1)))),
    "alpha_052": (((-1 * ts_min(low, 5)) + delay(ts_min(low, 5), 5)) * rank(((ts_sum(returns, 240) - ts_sum(returns, 20)) / 220))) * ts_rank(volume, 5),
    "alpha_053": -1 * delta((((close - low) - (high - close)) / (close - low)), 9),
    "alpha_054": (-1 * ((low - close) * (open_**5))) / ((low - high) * (close**5)),
    "alpha_055": -1 * ts_corr(rank(((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12)))), rank(volume), 6),
    "alpha_057": 0 - (1 * ((close - vwap) / decay_linear(rank(ts_argmax(close, 30)), 2))),
    "alpha_060": 0 - (1 * ((2 * scale(rank(((((close - low) - (high - close)) / (high - low)) * volume)))) - scale(rank(ts_argmax(close, 10))))),
    "alpha_061": rank((vwap - ts_min(vwap, 16.1219))) < rank(ts_corr(vwap, adv(180), 17.9282)),
    "alpha_062": (rank(ts_corr(vwap, ts_sum(adv(20), 22.4101), 9.91009)) < rank(((rank(open_) + rank(open_)) < (rank(((high + low) / 2)) + rank(high))))) * -1,
    "alpha_064": (rank(ts_corr(ts_sum(((open_ * 0.178404) + (low * (1 - 0.178404))), 12.7054), ts_sum(adv(120), 12.7054), 16.6208)) < rank(delta(((((high + low) / 2) * 0.178404) + (vwap * (1 - 0.178404))), 3.69741))) * -1,
    "alpha_065": (rank(ts_corr(((open_ * 0.00817205) + (vwap * (1 - 0.00817205))), ts_sum(adv(60), 8.6911), 6.40374)) < rank((open_ - ts_min(open_, 13.635)))) * -1,
    "alpha_066": (rank(decay_linear(delta(vwap, 3.51013), 7.23052)) + ts_rank(decay_linear(((((low * 0.96633) + (low * (1 - 0.96633))) - vwap) / (open_ - ((high + low) / 2))), 11.4157), 6.72611)) * -1,
    "alpha_068": (ts_rank(ts_corr(rank(high), rank(adv(15)), 8.91644), 13.9333) < rank(delta(((close * 0.518371) + (low * (1 - 0.518371))), 1.06157))) * -1,
    "alpha_071": max_(ts_rank(decay_linear(ts_corr(ts_rank(close, 3.43976), ts_rank(adv(180), 12.0647), 18.0175), 4.20501), 15.6948), ts_rank(decay_linear((rank(((low + open_) - (vwap + vwap)))**2), 16.4662), 4.4388)),
    "alpha_072": rank(decay_linear(ts_corr(((high + low) / 2), adv(40), 8.93345), 10.1519)) / rank(decay_linear(ts_corr(ts_rank(vwap, 3.72469), ts_rank(volume, 18.5188), 6.86671), 2.95011)),
    "alpha_073": max_(rank(decay_linear(delta(vwap, 4.72775), 2.91864)), ts_rank(decay_linear(((delta(((open_ * 0.147155) + (low * (1 - 0.147155))), 2.03608) / ((open_ * 0.147155) + (low * (1 - 0.147155)))) * -1), 3.33829), 16.7411)) * -1,
    "alpha_074": (rank(ts_corr(close, ts_sum(adv(30), 37.4843), 15.1365)) < rank(ts_corr(rank(((high * 0.0261661) + (vwap * (1 - 0.0261661)))), rank(volume), 11.4791))) * -1,
    "alpha_075": rank(ts_corr(vwap, volume, 4.24304)) < rank(ts_corr(rank(low), rank(adv(50)), 12.4413)),
    "alpha_077": min_(rank(decay_linear(((((high + low) / 2) + high) - (vwap + high)), 20.0451)), rank(decay_linear(ts_corr(((high + low) / 2), adv(40), 3.1614), 5.64125))),
    "alpha_078": rank(ts_corr(ts_sum(((low * 0.352233) + (vwap * (1 - 0.352233))), 19.7428), ts_sum(adv(40), 19.7428), 6.83313))**rank(ts_corr(rank(vwap), rank(volume), 5.77492)),
    "alpha_081": (rank(log(ts_product(rank((rank(ts_corr(vwap, ts_sum(adv(10), 49.6054), 8.47743))**4)), 14.9655))) < rank(ts_corr(rank(vwap), rank(volume), 5.07914))) * -1,
    "alpha_083": safe_div((rank(delay(safe_div((high - low), (ts_sum(close, 5) / 5)), 2)) * rank(rank(volume))), safe_div(safe_div((high - low), (ts_sum(close, 5) / 5)), (vwap - close))),
    "alpha_084": signed_power(ts_rank((vwap - ts_max(vwap, 15.3217)), 20.7127), delta(close, 4.96796)),
    "alpha_085": rank(ts_corr(((high * 0.876703) + (close * (1 - 0.876703))), adv(30), 9.61331))**rank(ts_corr(ts_rank(((high + low) / 2), 3.70596), ts_rank(volume, 10.1595), 7.11408)),
    "alpha_086": (ts_rank(ts_corr(close, ts_sum(adv(20), 14.7444), 6.00049), 20.4195) < rank(((open_ + close) - (vwap + open_)))) * -1,
    "alpha_088": min_(rank(decay_linear(((rank(open_) + rank(low)) - (rank(high) + rank(close))), 8.06882)), ts_rank(decay_linear(ts_corr(ts_rank(close, 8.44728), ts_rank(adv(60), 20.6966), 8.01266), 6.65053), 2.61957)),
    "alpha_092": min_(ts_rank(decay_linear(((((high + low) / 2) + close) < (low + open_)), 14.7221), 18.8683), ts_rank(decay_linear(ts_corr(rank(low), rank(adv(30)), 7.58555), 6.94024), 6.80584)),
    "alpha_094": (rank((vwap - ts_min(vwap, 11.5783)))**ts_rank(ts_corr(ts_rank(vwap, 19.6462), ts_rank(adv(60), 4.02992), 18.0926), 2.70756)) * -1,
    "alpha_095": rank((open_ - ts_min(open_, 12.4105))) < ts_rank((rank(ts_corr(ts_sum(((high + low) / 2), 19.1351), ts_sum(adv(40), 19.1351), 12.8742))**5), 11.7584),
    "alpha_096": max_(ts_rank(decay_linear(ts_corr(rank(vwap), rank(volume), 3.83878), 4.16783), 8.38151), ts_rank(decay_linear(ts_argmax(ts_corr(ts_rank(close, 7.45404), ts_rank(adv(60), 4.13242), 3.65459), 12.6556), 14.0365), 13.4143)) * -1,
    "alpha_098": rank(decay_linear(ts_corr(vwap, ts_sum(adv(5), 26.4719), 4.58418), 7.18088)) - rank(decay_linear(ts_rank(ts_argmin(ts_corr(rank(open_), rank(adv(15)), 20.8187), 8.62571), 6.95668), 8.07206)),
    "alpha_099": (rank(ts_corr(ts_sum(((high + low) / 2), 19.8975), ts_sum(adv(60), 19.8975), 8.8136)) < rank(ts_corr(low, volume, 6.28259))) * -1,
    "alpha_101": (close - open_) / ((high - low) + 0.001),
    "amount_ret_corr": ts_corr(amount, ts_returns(close, 1), 30),
    "amt_chg_1m": ts_returns(amount, 1),
    "amt_roll_mean_20": ts_mean(amount, 20),
    "amt_roll_std_20": ts_std(amount, 20),
    "ret_10m": ts_returns(close, 10),
    "ret_1m": ts_returns(close, 1),
    "ret_30m": ts_returns(close, 30),
    "ret_5m": ts_returns(close, 5),
    "rv_10": sqrt(ts_sum(pow_(ts_returns(close, 1), 2), 10)),
    "rv_20": sqrt(ts_sum(pow_(ts_returns(close, 1), 2), 20)),
    "vol_roll_mean_20": ts_mean(volume, 20),
    "vol_roll_std_20": ts_std(volume, 20),
    "high_low_range": (ts_max(high, 30) - ts_min(low, 30)) / delay(open_, 29),
    "price_high_dev": (close - high_so_far) / high_so_far,
    "price_low_dev": (close - low_so_far) / low_so_far,
    "ret_1": ts_returns(close, 1),
    "ret_10": ts_returns(close, 10),
    "ret_30": ts_returns(close, 30),
    "ret_5": ts_returns(close, 5),
    "ret_60": ts_returns(close, 60),
    "ret_open": close / open0 - 1,
    "vol_change_1": volume / ts_mean(volume, 5),
    "vol_change_5": ts_sum(volume, 5) / (ts_mean(volume, 30) * 5),
    "volatility_10": ts_std(ts_returns(close, 1), 10),
    "volatility_30": ts_std(ts_returns(close, 1), 30),
    "vwap_dev": (close - vwap) / vwap,
}

#: Earlier bars that a factor looks back to.
LOOKBACK: dict[str, int] = {
    "alpha_001": 23, "alpha_002": 7, "alpha_003": 9, "alpha_004": 8, "alpha_005": 9, "alpha_006": 9, "alpha_007": 66, "alpha_008": 14,
    "alpha_009": 5, "alpha_010": 4, "alpha_011": 3, "alpha_012": 1, "alpha_013": 4, "alpha_014": 9, "alpha_015": 4, "alpha_016": 4,
    "alpha_017": 24, "alpha_018": 9, "alpha_019": 249, "alpha_020": 1, "alpha_021": 20, "alpha_022": 19, "alpha_023": 19, "alpha_024": 199,
    "alpha_025": 20, "alpha_026": 10, "alpha_027": 6, "alpha_028": 24, "alpha_029": 10, "alpha_030": 19, "alpha_031": 31, "alpha_032": 234,
    "alpha_033": 0, "alpha_034": 4, "alpha_035": 31, "alpha_036": 199, "alpha_037": 200, "alpha_038": 9, "alpha_039": 249, "alpha_040": 9,
    "alpha_041": 0, "alpha_042": 0, "alpha_043": 39, "alpha_044": 4, "alpha_045": 24, "alpha_046": 20, "alpha_047": 20, "alpha_049": 20,
    "alpha_050": 8, "alpha_051": 20, "alpha_052": 239, "alpha_053": 9, "alpha_054": 0, "alpha_055": 16, "alpha_057": 30, "alpha_060": 9,
    "alpha_061": 196, "alpha_062": 49, "alpha_064": 146, "alpha_065": 72, "alpha_066": 15, "alpha_068": 34, "alpha_071": 225, "alpha_072": 56,
    "alpha_073": 19, "alpha_074": 80, "alpha_075": 61, "alpha_077": 46, "alpha_078": 63, "alpha_081": 78, "alpha_083": 6, "alpha_084": 33,
    "alpha_085": 38, "alpha_086": 57, "alpha_088": 92, "alpha_092": 46, "alpha_094": 81, "alpha_095": 79, "alpha_096": 101, "alpha_098": 53,
    "alpha_099": 85, "alpha_101": 0, "amount_ret_corr": 30, "amt_chg_1m": 1, "amt_roll_mean_20": 19, "amt_roll_std_20": 19, "ret_10m": 10, "ret_1m": 1,
    "ret_30m": 30, "ret_5m": 5, "rv_10": 10, "rv_20": 20, "vol_roll_mean_20": 19, "vol_roll_std_20": 19, "high_low_range": 29, "price_high_dev": 0,
    "price_low_dev": 0, "ret_1": 1, "ret_10": 10, "ret_30": 30, "ret_5": 5, "ret_60": 60, "ret_open": 0, "vol_change_1": 4,
    "vol_change_5": 29, "volatility_10": 10, "volatility_30": 30, "vwap_dev": 0,
}

DEFAULT = ["amount_ret_corr", "high_low_range", "price_high_dev", "price_low_dev", "ret_1", "ret_10", "ret_30", "ret_5", "ret_60", "ret_open", "vol_change_1", "vol_change_5", "volatility_10", "volatility_30", "vwap_dev"]
ALPHA = ["alpha_001", "alpha_002", "alpha_003", "alpha_004", "alpha_005", "alpha_007", "alpha_008", "alpha_009", "alpha_010", "alpha_011", "alpha_012", "alpha_013", "alpha_015", "alpha_016", "alpha_017", "alpha_018", "alpha_019", "alpha_020", "alpha_021", "alpha_022", "alpha_023", "alpha_024", "alpha_025", "alpha_026", "alpha_027", "alpha_028", "alpha_029", "alpha_030", "alpha_031", "alpha_032", "alpha_033", "alpha_034", "alpha_035", "alpha_036", "alpha_037", "alpha_038", "alpha_039", "alpha_040", "alpha_041", "alpha_042", "alpha_043", "alpha_044", "alpha_045", "alpha_046", "alpha_047", "alpha_049", "alpha_051", "alpha_052", "alpha_053", "alpha_054", "alpha_055", "alpha_057", "alpha_060", "alpha_061", "alpha_062", "alpha_064", "alpha_065", "alpha_066", "alpha_068", "alpha_071", "alpha_073", "alpha_074", "alpha_075", "alpha_077", "alpha_081", "alpha_083", "alpha_084", "alpha_085", "alpha_086", "alpha_088", "alpha_092", "alpha_094", "alpha_095", "alpha_098", "alpha_099"]
FUND = ["amt_chg_1m", "amt_roll_mean_20", "amt_roll_std_20", "ret_10m", "ret_1m", "ret_30m", "ret_5m", "rv_10", "rv_20", "vol_roll_mean_20", "vol_roll_std_20"]
LIBRARY_ONLY = ["alpha_006", "alpha_014", "alpha_050", "alpha_072", "alpha_078", "alpha_096", "alpha_101"]
#: Clipped at their 1st and 99th percentile of each time and ranked.
CLIP_RANKED = ["alpha_019", "alpha_024", "alpha_041", "alpha_042", "alpha_053", "alpha_057", "alpha_083", "alpha_084"]
#: NULL from the first invalid bar of a day on.
MASKED = ["alpha_001", "alpha_002", "alpha_003", "alpha_004", "alpha_005", "alpha_007", "alpha_008", "alpha_009", "alpha_010", "alpha_011", "alpha_012", "alpha_013", "alpha_015", "alpha_016", "alpha_017", "alpha_018", "alpha_019", "alpha_020", "alpha_021", "alpha_022", "alpha_023", "alpha_024", "alpha_025", "alpha_026", "alpha_027", "alpha_028", "alpha_029", "alpha_030", "alpha_031", "alpha_032", "alpha_033", "alpha_034", "alpha_035", "alpha_036", "alpha_037", "alpha_038", "alpha_039", "alpha_040", "alpha_041", "alpha_042", "alpha_043", "alpha_044", "alpha_045", "alpha_046", "alpha_047", "alpha_049", "alpha_051", "alpha_052", "alpha_053", "alpha_054", "alpha_055", "alpha_057", "alpha_060", "alpha_061", "alpha_062", "alpha_064", "alpha_065", "alpha_066", "alpha_068", "alpha_071", "alpha_073", "alpha_074", "alpha_075", "alpha_077", "alpha_081", "alpha_083", "alpha_084", "alpha_085", "alpha_086", "alpha_088", "alpha_092", "alpha_094", "alpha_095", "alpha_098", "alpha_099", "price_high_dev", "price_low_dev", "ret_open", "vwap_dev"]
